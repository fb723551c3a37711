"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced code point.

Near pairs. Groups of words are sorted and scanned with the edit matrix's band. Words with a common prefix share
their rows, so a row is computed once per distinct prefix of the sorted list (where the common prefix of two
neighbours ends, a new row begins), for all words still near that prefix; a word whose row already exceeds one
edit skips the whole range that shares the prefix. Between words of m and of m or m + 1 code points the band has two
places: equal lengths, and one code point more on the list's side.

Groups. A pair with a shorter word of m code points agrees in a leading or in a trailing part around its edit: it
meets either under its first m // 2 code points or under its last m - m // 2. A group of more than GROUP_WORDS
words is divided again by the same rule over the part that is not shared yet, as often as needed, down to
one free code point, where the alphabet bounds the group. Every pair has one place: the length of its common prefix
says which way it goes at each division. So no task ever holds more than a bounded group, however many
words share an ending. Words with a shared ending are turned round, so that the shared part is the prefix there too.

Forms and roots. A word's form is its near word of largest count (ties: the smallest in code-point order), if that
is at least twice its own. Counts grow along forms, so following them ends; it is done by pointer doubling.

Defined cases: null and empty texts have no words; a null id reads as empty in the damage rule; repeated rows
count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.words import ascii_lower, body
from newsgauge.session import cut_lineage

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
GROUP_WORDS = 20_000
QUERIES = 4_000

FOUND = "word string, near long, best_n long, best string"


def vocabulary(
    docs: DataFrame, text: str = "text", damaged: tuple[str, int] | None = None, least_length: int = 5,
    least_count: int = 3,
) -> DataFrame:
    """(word, n): letter runs, A-Z in lower case, of enough code points and occurrences.

    ``damaged`` = (id column, m) deletes the code point h % length of a run whose h, the crc32 of
    "<id>:<run>", is a multiple of m: a repeatable supply of misspellings.
    """
    held = F.coalesce(F.col(damaged[0]).cast("string"), F.lit("")).alias("id") if damaged else F.lit("").alias("id")
    # a run never gets longer
    runs = F.filter(F.regexp_extract_all(ascii_lower(body(text)), F.lit(RUN), F.lit(0)),
                    lambda w: F.char_length(w) >= least_length)
    words = docs.select(held, F.explode(runs).alias("run"))
    if damaged:
        h = F.crc32(F.concat_ws(":", "id", "run"))
        words = words.select("run", h.alias("h")).select(
            F.when(F.col("h") % damaged[1] == 0, without(F.col("run"), F.col("h") % F.char_length("run")))
            .otherwise(F.col("run")).alias("run")).where(F.char_length("run") >= least_length)
    counts = words.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def without(word: Column, place: Column) -> Column:
    """The word without the code point at ``place`` (from 0)."""
    at = place.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def placed(words: DataFrame) -> DataFrame:
    """Every word twice: as the shorter one of a pair, and as the longer one of a pair with one code point less.

    (word, n, m, lead, trail, below): the group shares ``lead`` leading and ``trail`` trailing code points;
    its pairs have a common prefix of at least ``lead`` and less than ``below`` code points.
    """
    size = F.char_length("word")
    return words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).select(
        "*", F.lit(0).alias("lead"), F.lit(0).alias("trail"), (F.col("m") + 1).alias("below"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row in the two parts of its group: more leading or more trailing code points shared."""
    free = F.col("m") - F.col("lead") - F.col("trail")
    middle = F.col("lead") + F.floor(free / 2).cast("int")
    return rows.select("word", "n", "m", F.explode(F.array(
        F.struct(middle.alias("lead"), F.col("trail"), F.col("below")),
        F.struct(F.col("lead"), (F.col("m") - middle).alias("trail"), middle.alias("below")),
    )).alias("part")).select("word", "n", "m", "part.*")


def with_key(rows: DataFrame) -> DataFrame:
    """The group's key: its shape and the shared code points, as a hash."""
    return rows.withColumn("key", F.xxhash64(
        "m", "lead", "trail", "below", F.substring(F.col("word"), F.lit(1), F.col("lead")),
        F.when(F.col("trail") > 0, F.substring(F.col("word"), -F.col("trail"), F.col("trail")))))


def groups(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, n, m, lead, trail, below, key), divided until no group exceeds ``limit`` words."""
    open_rows, done = with_key(halved(placed(words))), None
    while True:
        open_rows = cut_lineage(open_rows)
        large = cut_lineage(open_rows.groupBy("key").agg(
            F.count("*").alias("size"), F.max(F.col("m") - F.col("lead") - F.col("trail")).alias("free")
        ).where((F.col("size") > limit) & (F.col("free") > 1)).select("key"))
        if large.isEmpty():
            return open_rows if done is None else done.union(open_rows)
        small = open_rows.join(large, "key", "left_anti").select(*open_rows.columns)
        done = small if done is None else done.union(small)
        open_rows = with_key(halved(open_rows.join(large, "key", "left_semi").drop("key"))).select(*open_rows.columns)


class WordList:
    """Words as one array of code points, turned round where the shared part is the ending."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.length = np.array([len(w) for w in words], np.int64)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.first = np.cumsum(self.length) - self.length

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code points, 0 where the word has none at that place."""
        inside = (place >= 0) & (place < self.length[word])
        where = np.where(inside, self.first[word] + place, 0)
        return np.where(inside, self.codes[where], 0)


def scan(words: WordList, group: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, other): each word of m code points with the other words within one edit of it, all in its group.

    The list is sorted by (group, word); ``m`` is the shorter length of each word's group.
    """
    n = len(words.length)
    queries_all = np.flatnonzero(words.length == m)
    out_q, out_w = [], []
    # nodes of a level: first positions of ranges that share a prefix; levels are walked for a few queries at a time
    levels = list(prefix_levels(words, group))
    for some in range(0, len(queries_all), QUERIES):
        query = queries_all[some:some + QUERIES]
        starts = levels[0]
        node = np.searchsorted(starts, query, side="right") - 1
        same, more = np.zeros(len(query), np.int8), np.full(len(query), 2, np.int8)
        for depth in range(1, len(levels)):
            children = levels[depth]
            end = np.append(starts[1:], n)
            low = np.searchsorted(children, starts[node])
            number = np.searchsorted(children, end[node]) - low
            parent = np.repeat(np.arange(len(node)), number)
            node = np.repeat(low - np.cumsum(number) + number, number) + np.arange(len(parent))
            query, same, more = query[parent], same[parent], more[parent]
            code = words.at(children[node], np.full(len(node), depth - 1))
            q_same = words.at(query, np.full(len(query), depth - 1))
            q_more = words.at(query, np.full(len(query), depth - 2))
            # one code point more on the list's side: a matched code point, or an insertion
            more = np.minimum(more + (q_more != code), same + 1)
            same = same + (q_same != code)
            near = np.minimum(same, more) <= 1
            query, node, same, more = query[near], node[near], same[near], more[near]
            starts = children
            word = children[node]
            # a node whose first word ends here is that word
            whole = words.length[word] == depth
            size = words.length[query]
            hit = whole & (((size == depth) & (same == 1)) | ((size == depth - 1) & (more <= 1)))
            out_q.append(query[hit])
            out_w.append(word[hit])
            if not len(query):
                break
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_w)


def prefix_levels(words: WordList, group: np.ndarray) -> Iterator[np.ndarray]:
    """For each depth, the first positions of the ranges that share so many code points, from the groups on."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    yield np.flatnonzero(new)
    depth, long = 0, np.arange(n)
    while True:
        depth += 1
        long = long[words.length[long] >= depth]
        if not len(long):
            return
        here = words.at(long, np.full(len(long), depth - 1))
        before = np.maximum(long - 1, 0)
        new[long] |= (here != words.at(before, np.full(len(long), depth - 1)))
        yield long[new[long]]


def common_prefix(words: WordList, a: np.ndarray, b: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Length of the common prefix in reading order; turned words are read from their end."""
    out = np.zeros(len(a), np.int64)
    alive, depth = np.arange(len(a)), 0
    while len(alive):
        x, y, t = a[alive], b[alive], turned[alive]
        left = words.at(x, np.where(t, words.length[x] - 1 - depth, depth))
        right = words.at(y, np.where(t, words.length[y] - 1 - depth, depth))
        alive = alive[(left == right) & (left != 0)]
        out[alive] += 1
        depth += 1
    return out


def near_in_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """FOUND rows of whole groups, sorted by (key, turned word): near words and the best of them, word by word."""
    words = WordList(frame["turned"].tolist(), frame["n"].to_numpy())
    query, other = scan(words, frame["key"].to_numpy(), frame["m"].to_numpy())
    shape = {c: frame[c].to_numpy() for c in ("lead", "below", "trail")}
    turned = shape["trail"][query] > shape["lead"][query]
    shared = common_prefix(words, query, other, turned)
    ours = (shared >= shape["lead"][query]) & (shared < shape["below"][query])
    query, other = query[ours], other[ours]
    # words of equal length find each other; a longer word is told by the shorter one
    longer = words.length[other] > words.length[query]
    word = np.concatenate([query, other[longer]])
    near = np.concatenate([other, query[longer]])
    read = frame["word"].to_numpy()
    return pd.DataFrame({"word": read[word], "other": read[near], "n": words.n[near]})


def near_words(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has near words."""
    rows = groups(words, limit).withColumn(
        "turned", F.when(F.col("trail") > F.col("lead"), F.reverse("word")).otherwise(F.col("word")))
    # groups in one piece each; a task takes them in order, a bounded number of words at a time
    dealt = rows.repartition("key").sortWithinPartitions("key", "turned")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, limit):
            pairs = near_in_groups(frame)
            if len(pairs):
                best = pairs.sort_values(["word", "n", "other"], ascending=[True, False, True])
                tally = best.groupby("word", sort=False).agg(
                    near=("other", "size"), best_n=("n", "first"), best=("other", "first"))
                yield tally.reset_index()

    found = dealt.mapInPandas(search, FOUND)
    return found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")
    ).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def whole_groups(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by key, in frames of whole groups of about ``limit`` rows."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < limit:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame["key"].to_numpy() != frame["key"].iloc[-1]
        cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: (word, form) followed to the last one."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(at.join(jump, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_groups(words: DataFrame, ratio: int = 2, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n)."""
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words, limit)
    accepted = F.col("best_n") >= ratio * F.col("n")
    judged = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("best")).alias("form"), F.when(accepted, F.col("best_n")).alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
