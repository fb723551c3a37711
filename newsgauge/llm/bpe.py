"""BPE encoding and decoding with a lexicon of the corpus's frequent words.

The vocabulary file's rules are followed: canonical composition, lower case character by character, words
as runs of letters, single digits, English contractions and runs of other marks, bytes as letters,
merges by rank inside a word, word ends marked. Words are counted over all rows; the at most
LEXICON_WORDS most frequent words, of at most LEXICON_CHARS characters, are merged once and compiled into a minimal acyclic transducer (see
lexicon.py), whose file is written to the shared folder, sent to every executor and memory-mapped
there. Texts are cut at white space first, which no word crosses; a task looks the words of each distinct
piece up in the transducer once, and merges words that it lacks exactly.

Strings of the file's special tokens in a text become those tokens, as the file's library does.
Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows are encoded
each; an empty table gives an empty result; other columns pass through ``encode`` untouched.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.llm.lexicon import Lexicon, build
from newsgauge.session import cut_lineage, scratch_path

LEXICON_WORDS = 20_000
LEXICON_CHARS = 64
CHUNK_CHARS = 2 << 20
COUNTER_WORDS = 200_000
REMEMBERED = 400_000
REMEMBERED_CHARS = 16 << 20
DECODED_ROWS = 1_000
SEPARATORS = re.compile("[\x1c-\x1f]")
MATRIX_WORDS = 8_192
MATRIX_BYTES = 40
SLOT_BITS = 18
NEVER = 1 << 40
SPACES = "\t-\r \x85" + "".join(
    map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
BLANKS = re.compile(f"[{SPACES}]+")
# in texts of these characters only, the letters are the ranges below, and the faster module will do
UNCOMMON = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
LATIN = r"a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
COMMON_WORDS = re.compile(
    rf"[{LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r 0-9{LATIN}]+"
)
ALL_WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+", regex.V0
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.lead = os.path.commonprefix(list(self.special))
        self.letters = byte_letters()
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None
        self.first = np.array([self.ids[c] for c in self.letters], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in self.letters], np.int64)
        self._tables(pairs)

    def _tables(self, pairs: list[tuple[str, str]]) -> None:
        """Hash tables from a pair of ids to its rank and merged id; keys that collide go one table on."""
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in pairs], np.int64)
        merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        left = np.arange(len(pairs))
        self.tables = []
        while len(left):
            slot = self._slot(keys[left], len(self.tables))
            _, chosen = np.unique(slot, return_index=True)
            table = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
            for column, values in zip(table, (keys, np.arange(len(pairs)), merged)):
                column[slot[chosen]] = values[left[chosen]]
            self.tables.append(table)
            left = np.delete(left, chosen)

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; words of like length are merged side by side in a matrix."""
        out: list[list[int]] = [[] for _ in words]
        spelled = [w.encode() for w in words]
        order = sorted(range(len(words)), key=lambda k: len(spelled[k]))
        for low in range(0, len(order), MATRIX_WORDS):
            part = order[low:low + MATRIX_WORDS]
            long = [k for k in part if len(spelled[k]) > MATRIX_BYTES]
            for k in long:
                out[k] = self.merge(words[k])
            part = part[:len(part) - len(long)]
            if not part:
                continue
            size = np.array([len(spelled[k]) for k in part])
            width = int(size[-1])
            data = np.frombuffer(b"".join(spelled[k].ljust(width, b"\0") for k in part), np.uint8)
            data = data.reshape(len(part), width)
            columns = np.arange(width)
            grid = np.where(columns < size[:, None], self.first[data], -1)
            rows = np.arange(len(part))
            grid[rows, size - 1] = self.last[data[rows, size - 1]]
            live = rows[size > 1]
            while len(live):
                now = grid[live]
                keys = np.where(now[:, 1:] >= 0, (now[:, :-1] << 32) | now[:, 1:], -2)
                rank, made = np.full(keys.shape, NEVER), np.zeros(keys.shape, np.int64)
                for level, (known, ranks, merged) in enumerate(self.tables):
                    slot = self._slot(keys, level)
                    found = known[slot] == keys
                    rank[found], made[found] = ranks[slot[found]], merged[slot[found]]
                at = rank.argmin(1)
                some = np.arange(len(live))
                go = rank[some, at] < NEVER
                live, now, made, at = live[go], now[go], made[go], at[go]
                some = np.arange(len(live))
                now[some, at] = made[some, at]
                shift = np.minimum(columns + (columns > at[:, None]), width)
                grid[live] = np.take_along_axis(np.pad(now, ((0, 0), (0, 1)), constant_values=-1), shift, 1)
            for k, row, n in zip(part, grid.tolist(), (grid >= 0).sum(1).tolist()):
                out[k] = row[:n]
        return out

    def merge(self, word: str) -> list[int]:
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        # the pair of lowest rank first, the leftmost on a tie; neighbours are linked by place
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            follow = after[k]
            if parts[k] is None or follow >= len(parts) or self.ranks.get((parts[k], parts[follow])) != rank:
                continue
            parts[k] += parts[follow]
            parts[follow] = None
            after[k] = after[follow]
            if after[k] < len(parts):
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else len(parts)
                if right < len(parts) and (parts[left], parts[right]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[(parts[left], parts[right])], left))
        return [self.ids[p] for p in parts if p in self.ids]


def split_words(text: str) -> list[str]:
    """The words of a text without special tokens."""
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return ALL_WORDS.findall(text) if UNCOMMON.search(text) else COMMON_WORDS.findall(text)


def pieces(text: str, words: Vocabulary) -> list[str]:
    """Words and special tokens in order; a special token carries a leading zero byte."""
    if words.specials is None or words.lead not in text:
        return split_words(text)
    out = []
    for part in words.specials.split(text):
        out += ["\0" + part] if part in words.special else split_words(part)
    return out


def cut(text: str) -> list[str]:
    """Pieces between white space; separators that only Python counts as space do not cut."""
    return [p for p in BLANKS.split(text) if p] if SEPARATORS.search(text) else text.split()


def chunks(texts: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in lists of at most about ``chars`` characters and the last text."""
    first, part, size = 0, [], 0
    for k, text in enumerate(texts):
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= chars:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def count_pieces(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, n) over all rows, a piece being what stands between white space."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            found = pa.RecordBatch.from_pydict(
                {"piece": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return found

        for batch in batches:
            for _, part in chunks(batch.column(0)):
                for text in part:
                    seen.update(cut(text))
                if len(seen) > COUNTER_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "piece string, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows, for words of at most LEXICON_CHARS; special tokens are no words."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(path)
        for batch in batches:
            seen: Counter = Counter()
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in pieces(piece, words):
                    if word[0] != "\0" and len(word) <= LEXICON_CHARS:
                        seen[word] += n
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return count_pieces(docs, text_col).mapInArrow(split, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """The most frequent words, at most ``size``, most frequent first.

    Counts fall into steps, 16 to each doubling; the highest steps that hold at most ``size`` words are taken, so that
    only the steps' sizes and the words taken come to the driver. A step that alone holds more is left out.
    """
    step = F.floor(F.log2(F.col("n")) * 16)
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    lowest, held = None, 0
    for level, number in sizes:
        held += number
        if held > size:
            break
        lowest = level
    if lowest is None:
        return []
    rows = counts.where(step >= lowest).collect()
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all rows, put the file before all executors, return its name."""
    spark = docs.sparkSession
    chosen = frequent_words(cut_lineage(count_words(docs, path, text_col)), size)
    words = Vocabulary(path)
    content = build({w.encode(): ids for w, ids in zip(chosen, words.merge_all(chosen))})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}/{name}")
    out = place.getFileSystem(conf).create(place)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(place.getFileSystem(conf).makeQualified(place).toString())
    return name


class Encoder:
    """Looks distinct pieces up once; it remembers at most ``remembered`` pieces of REMEMBERED_CHARS, and one chunk's.

    An encoder lives as long as its task, so that nothing stays behind in a worker that other stages use.
    """

    def __init__(self, words: Vocabulary, lexicon: Lexicon, remembered: int = REMEMBERED) -> None:
        self.words, self.lexicon, self.remembered = words, lexicon, remembered
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        split = [pieces(piece, self.words) for piece in new]
        distinct = list(dict.fromkeys(w for ws in split for w in ws))
        places = self.lexicon.places([w.encode() for w in distinct])
        ids: dict[str, list[int]] = {}
        unseen = []
        for word, place in zip(distinct, places.tolist()):
            if word[0] == "\0" and word[1:] in self.words.special:
                ids[word] = [self.words.special[word[1:]]]
            elif place >= 0:
                low, high = self.lexicon.offsets[place:place + 2]
                ids[word] = self.lexicon.ids[low:high].tolist()
            else:
                unseen.append(word)
        ids.update(zip(unseen, self.words.merge_all(unseen)))
        found = [[i for w in ws for i in ids[w]] for ws in split]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.chars += sum(map(len, new))
        self.size = np.concatenate([self.size, np.array([len(i) for i in found], np.int64)])
        self.flat = np.concatenate([self.flat, np.array([i for x in found for i in x], np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends of the texts' ids, all ids in order)."""
        parts: list[str] = []
        ends = []
        for text in texts:
            parts += cut(text)
            ends.append(len(parts))
        if len(self.index) > self.remembered or self.chars > REMEMBERED_CHARS:
            self._forget()
        new = [p for p in dict.fromkeys(parts) if p not in self.index]
        if new:
            self._learn(new)
        order = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        start = np.cumsum(self.size) - self.size
        lengths = self.size[order]
        before = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat(start[order] - before[:-1], lengths) + np.arange(before[-1])
        return before[np.array(ends, np.int64)], self.flat[gather]


def text_of(ids: np.ndarray, words: Vocabulary) -> str:
    return " ".join(map(words.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, lexicon: str, text_col: str = "text", out: str = "ids",
           keep_text: bool = True, decoded: str | None = None, chunk: int = CHUNK_CHARS,
           remembered: int = REMEMBERED) -> DataFrame:
    """All rows and columns (without the text if unwanted) with the array of token ids.

    ``decoded`` names a further column for the text of the ids, made in the same pass. Fewer characters in a ``chunk``
    and fewer pieces ``remembered`` take less of a task's memory and more of its time; the ids are the same.
    """
    kept = [c for c in docs.columns if c not in (out, decoded) and (keep_text or c != text_col)]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias("_encoded_text"))
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType())), *more])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(path)
        encoder = Encoder(words, Lexicon(SparkFiles.get(lexicon)), remembered)
        for batch in batches:
            for first, part in chunks(batch.column(width), chunk):
                ends, ids = encoder.encode(part)
                bounds = np.concatenate([[0], ends])
                made = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if more:
                    made.append(pa.array(
                        [text_of(ids[a:b], words) for a, b in zip(bounds, bounds[1:])], pa.string()))
                rest = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*[rest.column(k) for k in range(width)], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns with the text of the ids: the tokens' strings, joined by one blank."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, DECODED_ROWS):
                rest = batch.slice(first, DECODED_ROWS)
                texts = [text_of(x.values.to_numpy(), words) if x.is_valid else "" for x in rest.column(place)]
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
