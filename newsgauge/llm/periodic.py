"""Periodic runs of words: stretches that repeat with a smallest period at least three times.

A run is a stretch of consecutive words whose smallest period is q, at least max(MIN_LENGTH, REPEATS * q) long,
that no neighbouring word extends. All runs of a text are found, exactly:

* Texts are cut into words and words into numbers for many rows at once; a number of its own after each
  text keeps runs inside it.
* Periods up to SHORT are found by direct scans: equal words at each lag, stretch by stretch.
* Longer periods are found by minimizers at several scales. At the scale of k words, which covers periods in
  (2k/3, k], positions are hashed by their k words, and the smallest hash of every w = max(1, k // 3)
  positions is marked. Inside a run the marks repeat at period distance, and k words at two places of a run agree
  only at multiples of the period, so two neighbouring marks of one hash give the period. A run of three
  periods always holds such a pair: 2q - k + 1 >= w windows fit. The pair seeds an extension to both sides by
  direct comparison, so a hash collision costs time and never a result.
* A stretch found at several periods is one run with the smallest of them.

Texts are sorted by length inside a slice, so that large scales see only texts long enough for them. The work is
independent per text; a slice is bounded by SLICE_BYTES of text or one text.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows are answered alike; an empty
table gives an empty result; other columns are kept, but one that has a name in ``out`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 24
REPEATS = 3
SHORT = 16
SLICE_BYTES = 4 << 20

RUNS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()),
]))
SPREAD = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xBF58476D1CE4E5B9)


def scramble(values: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values."""
    values = (values + SPREAD) * TURN
    return (values ^ (values >> np.uint64(29))) * SPREAD


def stretch_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on, by doubling; a power of two that overlaps itself for the rest."""
    size, current = 1, hashes
    while size * 2 <= k:
        current = scramble(current[:-size] ^ (current[size:] * TURN))
        size *= 2
    rest = k - size
    return scramble(current[:len(current) - rest] ^ (current[rest:] * SPREAD)) if rest else current


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each w values."""
    size, current = 1, values
    while size * 2 <= w:
        current = pick(current[:-size], current[size:])
        size *= 2
    rest = w - size
    return pick(current[:len(current) - rest], current[rest:]) if rest else current


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest hash of some w neighbouring positions."""
    if len(hashes) < w:
        return np.empty(0, np.int64)
    lowest = sliding(hashes, w, np.minimum)
    # a position is marked if the largest minimum of the windows over it is its own hash
    edge = np.zeros(w - 1, hashes.dtype)
    reach = sliding(np.concatenate([edge, lowest, edge]), w, np.maximum)
    return np.flatnonzero(reach == hashes)


def equal_to_the_right(ids: np.ndarray, at: int, lag: int) -> int:
    """First position from ``at`` on that differs from the one ``lag`` later."""
    step, stop = 64, len(ids) - lag
    while at < stop:
        end = min(at + step, stop)
        differs = ids[at:end] != ids[at + lag:end + lag]
        if differs.any():
            return at + int(differs.argmax())
        at, step = end, step * 2
    return stop


def equal_to_the_left(ids: np.ndarray, at: int, lag: int) -> int:
    """Start of the equal stretch that ends before ``at``."""
    step = 64
    while at > 0:
        start = max(at - step, 0)
        differs = ids[start:at] != ids[start + lag:at + lag]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, step = start, step * 2
    return 0


def short_periods(ids: np.ndarray, longest: int, found: dict[tuple[int, int], int]) -> None:
    """Runs with a period up to SHORT by direct scans of every lag."""
    for lag in range(1, min(SHORT, longest // REPEATS) + 1):
        least = max(MIN_LENGTH, REPEATS * lag) - lag
        breaks = np.concatenate([[-1], np.flatnonzero(ids[:-lag] != ids[lag:]), [len(ids) - lag]])
        gaps = np.diff(breaks) - 1
        for k in np.flatnonzero(gaps >= least).tolist():
            start = int(breaks[k]) + 1
            found.setdefault((start, start + int(gaps[k]) + lag), lag)


def long_periods(
    ids: np.ndarray, hashes: np.ndarray, k: int, low: int, found: dict[tuple[int, int], int]
) -> None:
    """Runs with a period in (low, k]: pairs of equal minimizers, extended."""
    stretches = stretch_hashes(hashes, k)
    marks = window_minima(stretches, max(1, k // 3))
    order = marks[np.lexsort((marks, stretches[marks]))]
    lags = np.diff(order)
    seeds = np.flatnonzero((stretches[order[1:]] == stretches[order[:-1]]) & (lags > low) & (lags <= k))
    at, lags = order[seeds], lags[seeds]
    by_lag = np.lexsort((at, lags))
    last, covered = 0, -1
    for lag, start in zip(lags[by_lag].tolist(), at[by_lag].tolist()):
        if lag != last:
            last, covered = lag, -1
        if start < covered:
            continue
        right = equal_to_the_right(ids, start, lag)
        left = equal_to_the_left(ids, start, lag)
        covered = max(right, start + 1)
        if right - left + lag >= max(MIN_LENGTH, REPEATS * lag):
            span = (left, right + lag)
            found[span] = min(lag, found.get(span, lag))


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(low, k) of each scale for texts of up to ``longest`` words."""
    low = SHORT
    while low * REPEATS < longest:
        yield low, low * 3 // 2
        low = low * 3 // 2


def all_runs(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, end): period} in texts laid end to end by falling length, each closed by a number of its own."""
    found: dict[tuple[int, int], int] = {}
    longest = int(lengths[0]) if len(lengths) else 0
    if longest < MIN_LENGTH:
        return found
    part = ids[:int(ends[np.searchsorted(-lengths, -MIN_LENGTH, side="right") - 1])]
    short_periods(part, longest, found)
    hashes = scramble(ids.view(np.uint64))
    for low, k in scales(longest):
        texts = int(np.searchsorted(-lengths, -REPEATS * (low + 1), side="right"))
        if texts:
            end = int(ends[texts - 1])
            long_periods(ids[:end], hashes[:end], k, low, found)
    return found


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after the other, and each text's number of words."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    flat, owner = cut.flatten(), pc.list_parent_indices(cut)
    real = pc.not_equal(flat, "")
    counts = np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))
    return flat.filter(real), counts


def answer(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of every text."""
    words, counts = words_of(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    by_length = np.argsort(-counts, kind="stable")
    lengths = counts[by_length]
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    # place of each word in the arrangement by length
    place = np.empty(len(counts), np.int64)
    place[by_length] = starts
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    ids[ends - 1] = -1 - np.arange(len(ends))
    ids[np.arange(len(codes)) + np.repeat(place - first[:-1], counts)] = codes

    runs: list[list[dict[str, int]]] = [[] for _ in range(len(counts))]
    change = np.zeros(len(codes) + 1, np.int64)
    for (start, end), period in sorted(all_runs(ids, ends, lengths).items(), key=lambda r: (r[0][0], r[1])):
        slot = int(np.searchsorted(starts, start, side="right")) - 1
        text = int(by_length[slot])
        at = start - int(starts[slot])
        runs[text].append({"start": at, "length": end - start, "period": period})
        change[first[text] + at + period] += 1
        change[first[text] + at + end - start] -= 1
    kept = np.cumsum(change[:-1]) == 0
    per_text = np.concatenate([[0], np.cumsum(kept)])[first]
    listed = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), words.filter(pa.array(kept)))
    collapsed = pc.binary_join(listed, " ")
    return pa.array(runs, pa.list_(pa.struct([
        ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), collapsed


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, number) of neighbouring rows, at most SLICE_BYTES or one row."""
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > SLICE_BYTES:
            yield start, k - start
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start


def find_runs(docs: DataFrame, text: str = "text", out: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """All rows and columns but the text, the runs by (start, period), and the words of the text without those that any run
    repeats (all words of a run after its first period), joined by one space."""
    others = [c for c in docs.columns if c not in (text, *out)]
    layout = T.StructType([docs.schema[c] for c in others] + [
        T.StructField(out[0], RUNS), T.StructField(out[1], T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(others))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for start, number in slices(sizes):
                runs, collapsed = answer(texts.slice(start, number))
                part = batch.slice(start, number)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(others))] + [runs, collapsed.cast(pa.string())],
                    names=layout.names)

    return docs.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(search, layout)
