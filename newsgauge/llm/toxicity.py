"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words, hashed to buckets. The machine scores
w0 + sum of w_i + sum over pairs of <v_i, v_j>, so a pair of terms (an insult beside a group's name)
can weigh more or less than its parts. Terms are found in the JVM; only the few buckets that the
machine knows reach Python.

Training takes at most TRAIN_ROWS labelled rows (those first by a hash of their id); their terms are gathered
whole. A term enters the machine when it tells the classes apart by itself (chi2 of at least MIN_CHI2), or
when it belongs to a pair that does: among the rows with one term of the pair, the presence of the other must
change the share of toxic rows by a likelihood ratio statistic of at least MIN_PAIR, from both sides. All pairs of the
sample are counted, by the executors; only terms whose rows could not reach that statistic under any
partner are left out beforehand. The number of terms is not limited. Everything is scored.

Defined cases: null and empty texts have no terms and get the score of w0; rows without id or label
are not learned from; several labels of one id count as their maximum; without any labels, or with
one class only, the score is the share of toxic labels (0 without labels). Repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 20
TRAIN_ROWS = 20_000
FACTORS = 8
MIN_CHI2 = 25.0
MIN_PAIR = 25.0
BATCH = 2_000
WORD_BREAK = r"[^\p{L}\p{N}]+"


@dataclass
class Machine:
    terms: list[int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for n rows, given as (row, column) pairs of present terms."""
        linear = np.bincount(rows, self.weights[columns], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[columns, f]
            pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -40, 40)))


def term_buckets(text: Column) -> Column:
    """Distinct buckets of the words of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK)
    return F.array_distinct(F.transform(
        F.filter(words, lambda w: w != ""), lambda w: (F.crc32(w) % BUCKETS).cast("int")
    ))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.05,
        decay: tuple[float, float] = (1e-5, 3e-3)) -> tuple[float, np.ndarray, np.ndarray]:
    """``fit_rows`` for a matrix of 0 and 1."""
    rows, columns = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(len(x) + 1))
    return fit_rows(columns, starts, x.shape[1], y, steps, rate, decay)


def fit_rows(columns: np.ndarray, starts: np.ndarray, k: int, y: np.ndarray, steps: int = 600, rate: float = 0.05,
             decay: tuple[float, float] = (1e-5, 3e-3)) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the penalised log-loss of all rows and y.

    Row r has the terms columns[starts[r]:starts[r + 1]] of k. A step takes the next BATCH rows of a shuffled
    order that is drawn anew when it is used up, so every row is met; fewer rows are taken whole.
    Pairs are penalised more than single terms, so that a term seen alone keeps its own weight.
    """
    n = len(y)
    rng = np.random.default_rng(7)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.05, (k, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sizes, order = np.diff(starts), np.arange(n)
    columns = columns.astype(np.int32)

    for step in range(1, steps + 1):
        bias, w, v = params
        batch = order
        if n > BATCH:
            if len(order) < BATCH or step == 1:
                order = rng.permutation(n) if step == 1 else np.concatenate([order, rng.permutation(n)])
            batch, order = order[:BATCH], order[BATCH:]
        # the batch's terms, row by row; memory follows the terms that are there, not rows times all terms
        size = sizes[batch]
        row = np.repeat(np.arange(len(batch)), size)
        term = columns[np.repeat(starts[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        per_row = lambda values: np.bincount(row, values, len(batch))
        sums = np.stack([per_row(v[term, f]) for f in range(FACTORS)], 1)
        raw = bias + per_row(w[term]) + (sums**2).sum(1) / 2 - per_row((v * v).sum(1)[term]) / 2
        error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[batch]
        mass = np.bincount(term, error[row], k)
        joint = np.stack([np.bincount(term, (error * sums[:, f])[row], k) for f in range(FACTORS)], 1)
        grads = [
            np.array([error.mean()]),
            mass / len(batch) + decay[0] * w,
            (joint - mass[:, None] * v) / len(batch) + decay[1] * v,
        ]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def pair_terms(spark: SparkSession, columns: np.ndarray, starts: np.ndarray, k: int, y: np.ndarray) -> np.ndarray:
    """The terms, of k, that stand in a pair which tells the classes apart beyond either of its terms."""
    n = len(y)
    xlogx = np.arange(n + 1) * np.log(np.maximum(np.arange(n + 1), 1))
    rows = np.repeat(np.arange(n), np.diff(starts))
    m, a = np.bincount(columns, minlength=k), np.bincount(columns, y[rows], k).astype(np.int64)
    # no split of a term's rows tells more than the classes themselves
    able = np.flatnonzero(2 * (xlogx[m] - xlogx[a] - xlogx[m - a]) >= MIN_PAIR)
    place = np.full(k, -1)
    place[able] = np.arange(len(able))
    kept = place[columns] >= 0
    rows, columns = rows[kept], place[columns[kept]].astype(np.int32)
    order = np.lexsort((columns, rows))
    rows, columns = rows[order], columns[order]
    ends = np.searchsorted(rows, rows, "right").astype(np.int32)
    # for each term, where it stands, rows of label 1 first
    posts = np.lexsort((-y[rows], columns)).astype(np.int32)
    first = np.searchsorted(columns[posts], np.arange(len(able) + 1))
    parts = 4 * spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast((columns, ends, posts, first, m[able], a[able], xlogx, parts))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, ends, posts, first, m, a, xlogx, parts = shared.value

        def told(both_a, both_m, all_a, all_m):
            """Twice the log-likelihood ratio of label and partner among the all_m rows of a term."""
            cells = (both_a, both_m - both_a, all_a - both_a, all_m - all_a - both_m + both_a)
            sides = (both_m, all_m - both_m, all_a, all_m - all_a)
            return 2 * (sum(xlogx[c] for c in cells) - sum(xlogx[c] for c in sides) + xlogx[all_m])

        def count(places, width):
            pieces = [columns[p + 1:ends[p]] for p in places]
            return np.bincount(np.concatenate(pieces), minlength=width) if pieces else np.zeros(width, np.int64)

        for batch in batches:
            for part in batch["id"]:
                for i in range(part, len(m), parts):
                    at = posts[first[i]:first[i + 1]]
                    both_a = count(at[:a[i]], len(m))
                    both_m = both_a + count(at[a[i]:], len(m))
                    others = np.flatnonzero(both_m)
                    pa, pm = both_a[others], both_m[others]
                    hits = others[(told(pa, pm, a[i], m[i]) >= MIN_PAIR) & (told(pa, pm, a[others], m[others]) >= MIN_PAIR)]
                    if len(hits):
                        yield pd.DataFrame({"term": np.append(hits, i).astype(np.int64)})

    pairs = spark.range(0, parts, 1, parts).mapInPandas(found, "term long").distinct().collect()
    shared.destroy()
    return able[sorted(r["term"] for r in pairs)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Fit the machine on at most ``rows`` labelled rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")) \
        .join(F.broadcast(known), "_id").groupBy("_id", "_y") \
        .agg(F.array_distinct(F.flatten(F.collect_set(term_buckets(F.col("_t"))))).alias("_terms"))
    data = sample.orderBy("_id").select("_y", "_terms").toArrow().combine_chunks()
    y = (data["_y"].to_numpy() > 0).astype(np.int32)
    n, pos = len(y), int(y.sum())
    if pos in (0, n):
        bias = 40.0 if pos else -40.0
        return Machine([], bias, np.zeros(0), np.zeros((0, FACTORS)))
    lists = data["_terms"].combine_chunks()
    buckets, columns = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    columns = columns.astype(np.int32)
    starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    k = len(buckets)
    m = np.bincount(columns, minlength=k).astype(float)
    a = np.bincount(columns, np.repeat(y, np.diff(starts)), k)
    chi2 = n * (a * (n - pos) - (m - a) * pos) ** 2 / (m * np.maximum(n - m, 1) * pos * (n - pos))
    alone = np.flatnonzero((m >= 3) & (m < n) & (chi2 >= MIN_CHI2))
    chosen = np.union1d(alone, pair_terms(docs.sparkSession, columns, starts, k, y)).astype(np.int64)
    place = np.full(k, -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[columns] >= 0
    ends = np.append(0, np.cumsum(kept))[starts]
    # a prior of the same width for any number of rows: a pair in few of many rows can be learned
    bias, w, v = fit_rows(place[columns[kept]], ends, len(chosen), y.astype(np.float64), decay=(1e-5, 2 / n))
    return Machine(buckets[chosen].tolist(), bias, w, v)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns, with the machine's score as column ``out``, which replaces one of that name."""
    terms = np.array(machine.terms, np.int64)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            sizes = found.str.len().to_numpy(np.int64)
            flat = np.concatenate([np.asarray(f, np.int64) for f in found]) if sizes.sum() \
                else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(found)), sizes)
            yield pd.Series(machine.score(rows, np.searchsorted(terms, flat), len(found)))

    known = F.array_intersect(
        term_buckets(F.col(text_col)), F.lit(machine.terms).cast("array<int>")
    )
    return docs.withColumn(out, scored(known))
