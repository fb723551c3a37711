"""Granger tests and vector autoregressions for every key of a monthly panel."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge import fixed_values as fixed
from newsgauge.functions import inference as inf
from newsgauge.functions.gram import gram_sums, part, swept
from newsgauge.functions.stats import series_window
from newsgauge.operators.leadlag import cross_correlation, optimal_lag
from newsgauge.operators.panel import difference
from newsgauge.operators.stationarity import ALPHA, stationarity
from newsgauge.session import cut_lineage

MAX_GRANGER_LAG = 4


def _lagged(panel: DataFrame, keys: Sequence[str], columns: Sequence[str], max_lag: int) -> DataFrame:
    """(keys, pos, v0, v1, .., v0_1, ..): complete rows by month, centred per key, with their lags.

    Centring leaves slopes and residuals alone and keeps the sums of products small.
    """
    rows = panel.dropna(subset=list(columns)).select(
        *keys, "month", *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    centred = rows.select(*keys, "month", *[
        (F.col(f"v{k}") - F.avg(f"v{k}").over(series_window(keys))).alias(f"v{k}") for k in range(len(columns))])
    ordered = series_window(keys, ["month"])
    return centred.select(
        *keys, F.row_number().over(ordered).alias("pos"), *[f"v{k}" for k in range(len(columns))],
        *[F.lag(f"v{k}", j).over(ordered).alias(f"v{k}_{j}")
          for k in range(len(columns)) for j in range(1, max_lag + 1)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _f_tails(values: pd.Series, rows: pd.Series) -> pd.Series:
    """p-value of the F value of each lag order, from 1."""
    return pd.Series([
        None if v is None else [inf.f_tail(f, p, n - 3 * p - 1) if math.isfinite(f) else 0.0 for p, f in enumerate(v, 1)]
        for v, n in zip(values, rows)], dtype=object)


def granger_panel(
    pairs: DataFrame, keys: Sequence[str], x: str = "s1", y: str = "s2",
    max_lag: int = MAX_GRANGER_LAG, alpha: float = ALPHA,
) -> DataFrame:
    """Does x help to predict y? F and p-value per lag, the smallest p-value, and its first lag.

    The products of all lags are summed per key in one aggregate, for every lag order on its own sample.

    A key needs 2 * max_lag + 24 joint rows; shorter or constant ones give NULL and False.
    """
    lagged = _lagged(pairs, keys, [y, x], max_lag)
    grams = lagged.groupBy(*keys).agg(
        F.count("*").alias("n_observations"),
        *[F.expr(f"max(v{k}) > min(v{k})").alias(f"varies{k}") for k in (0, 1)],
        *[gram_sums(["1.0D", *[f"v0_{j}" for j in range(1, p + 1)], *[f"v1_{j}" for j in range(1, p + 1)], "v0"],
                    f"pos > {p}").alias(f"gram{p}") for p in range(1, max_lag + 1)],
    )
    enough = (F.col("n_observations") >= 2 * max_lag + fixed.MIN_OBSERVATIONS) & F.col("varies0") & F.col("varies1")
    solved = grams.select(*keys, "n_observations", enough.alias("enough"), *[
        swept(F.col(f"gram{p}"), 1 + 2 * p)["corners"].alias(f"rss{p}") for p in range(1, max_lag + 1)
    ])

    def f_value(p: int) -> Column:
        """Lags of the target stand before lags of the other series: both sums of squares come from one elimination."""
        own, joint = F.get(f"rss{p}", F.lit(1 + p)), F.get(f"rss{p}", F.lit(1 + 2 * p))
        free = F.col("n_observations") - (3 * p + 1)
        return F.coalesce(F.try_divide((own - joint) * free, joint * p), F.lit(math.inf))

    tested = solved.select(*keys, "n_observations", F.when(
        F.col("enough"), F.array(*[f_value(p) for p in range(1, max_lag + 1)])).alias("f_statistics"))
    tested = tested.withColumn("pvalues", _f_tails("f_statistics", F.col("n_observations").cast("long")))
    smallest = F.array_min("pvalues")
    return tested.select(
        *keys, "n_observations", "f_statistics", "pvalues",
        smallest.alias("min_pvalue"),
        F.when(smallest.isNotNull(), F.array_position("pvalues", smallest).cast("int"))
        .alias("optimal_lag"),
        F.coalesce(smallest < alpha, F.lit(False)).alias("granger_causes"),
    )


def granger_bidirectional(
    pairs: DataFrame, keys: Sequence[str], x: str = "s1", y: str = "s2",
    max_lag: int = MAX_GRANGER_LAG, alpha: float = ALPHA,
) -> DataFrame:
    """Both directions and the relationship they amount to."""
    def side(a: str, b: str, name: str) -> DataFrame:
        return granger_panel(pairs, keys, a, b, max_lag, alpha).select(
            *keys,
            F.col("granger_causes").alias(f"{name}_causes"),
            F.col("min_pvalue").alias(f"{name}_pvalue"),
            F.col("optimal_lag").alias(f"{name}_lag"),
        )

    pairs = cut_lineage(pairs.select(*keys, "month", x, y))
    both = side(x, y, "forward").join(side(y, x, "backward"), list(keys))
    return both.withColumn(
        "relationship",
        F.when(F.col("forward_causes") & F.col("backward_causes"), "bidirectional")
        .when(F.col("forward_causes"), f"{x}_causes_{y}")
        .when(F.col("backward_causes"), f"{y}_causes_{x}")
        .otherwise("no_granger_causality"),
    )


def var_panel(
    panel: DataFrame, keys: Sequence[str], columns: Sequence[str], max_lag: int = MAX_GRANGER_LAG
) -> DataFrame:
    """Vector autoregression per key; coefficients as JSON matrices, one per lag.

    A key needs max_lag * columns + 24 complete rows.
    """
    missing = [c for c in columns if c not in panel.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    k = len(columns)
    names = [[f"v{c}_{j}" for c in range(k)] for j in range(1, max_lag + 1)]
    targets = [f"v{c}" for c in range(k)]
    lagged = _lagged(panel, keys, columns, max_lag)
    full = ["1.0D", *[n for row in names for n in row], *targets]
    grams = lagged.groupBy(*keys).agg(
        F.count("*").alias("n_observations"), gram_sums(full, f"pos > {max_lag}").alias("common"),
        *[gram_sums(["1.0D", *[n for row in names[:p] for n in row], *targets], f"pos > {p}").alias(f"own{p}")
          for p in range(max_lag + 1)],
    )

    def logdet(matrix: Column, steps: Column | int, n: Column) -> Column:
        """Log-determinant of the residual covariance: the pivots that the targets have after all regressors."""
        pivots = swept(matrix, steps)["pivots"]
        logs = F.transform(F.slice(pivots, -k, k), lambda v: F.log(v / n))
        return F.aggregate(logs, F.lit(0.0), lambda total, v: total + v)

    n = F.col("n_observations").cast("double")
    parts = grams.select(*keys, "n_observations", *[f"own{p}" for p in range(max_lag + 1)], *[
        part(F.col("common"), 1 + p * k, len(full), k).alias(f"nested{p}") for p in range(max_lag + 1)])
    criteria = parts.select(*keys, "n_observations", *[f"own{p}" for p in range(max_lag + 1)], F.array(*[
        logdet(F.col(f"nested{p}"), 1 + p * k + k, n - max_lag) + 2.0 * (p * k * k + k) / (n - max_lag)
        for p in range(max_lag + 1)]).alias("criteria"))
    usable = (F.col("n_observations") >= max_lag * k + fixed.MIN_OBSERVATIONS) \
        & ~F.exists("criteria", lambda v: v.isNull())
    chosen = criteria.select(
        *keys, "n_observations", F.array(*[f"own{p}" for p in range(max_lag + 1)]).alias("own"),
        F.when(usable, F.array_position("criteria", F.array_min("criteria")).cast("int") - 1).alias("optimal_lag"),
    ).select(*keys, "n_observations", "optimal_lag", F.get("own", F.col("optimal_lag")).alias("own"))
    rows = n - F.col("optimal_lag")
    free = F.col("optimal_lag") * (k * k) + k
    solved = chosen.select(
        *keys, "n_observations", "optimal_lag", swept(F.col("own"), 1 + F.col("optimal_lag") * k)["m"].alias("beta"),
        logdet(F.col("own"), 1 + F.col("optimal_lag") * k + k, rows).alias("logdet"), rows.alias("rows"),
        free.alias("free"))
    orders = F.when(F.col("optimal_lag") > 0, F.sequence(F.lit(0), F.col("optimal_lag") - 1)) \
        .otherwise(F.array().cast("array<int>"))
    matrices = F.transform(orders, lambda j: F.array(*[
        F.array(*[F.get(F.get("beta", 1 + j * k + b), 1 + F.col("optimal_lag") * k + a) for b in range(k)])
        for a in range(k)]))
    fitted = F.col("optimal_lag").isNotNull() & F.col("logdet").isNotNull()
    return solved.select(
        *keys, "n_observations", fitted.alias("fitted"),
        F.when(fitted, F.col("optimal_lag")).alias("optimal_lag"),
        F.when(fitted, F.col("logdet") + 2.0 * F.col("free") / F.col("rows")).alias("aic"),
        F.when(fitted, F.col("logdet") + F.log("rows") * F.col("free") / F.col("rows")).alias("bic"),
        F.when(fitted, F.to_json(matrices)).alias("coefficients"))


def leadlag_report(
    pairs: DataFrame, keys: Sequence[str], x: str = "s1", y: str = "s2",
    max_lag: int = fixed.MAX_LAG, max_granger_lag: int = MAX_GRANGER_LAG, alpha: float = ALPHA,
) -> DataFrame:
    """One summary row per key: verdicts, strongest lag, and Granger tests.

    Granger tests use first differences as soon as one side needs differencing. Keys with fewer
    than 24 joint rows have status 'error' and nothing else.
    """
    keys = list(keys)
    # One row per key and month, read by every test below: computed once and kept.
    joint = cut_lineage(pairs.select(*keys, "month", x, y).dropna(subset=[x, y]))
    sizes = joint.groupBy(*keys).agg(
        F.count("*").alias("n_observations"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
    )
    sides = joint.select(*keys, "month", F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(c).cast("double").alias("value"))
        for side, c in (("x", x), ("y", y))
    ])))

    def verdict(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    verdicts = stationarity(sides, [*keys, "side"], alpha=alpha).groupBy(*keys).agg(
        verdict("x", "conclusion").alias("x_conclusion"),
        verdict("y", "conclusion").alias("y_conclusion"),
        F.coalesce(F.max("differencing_needed"), F.lit(False)).alias("differenced"),
    )
    best = optimal_lag(
        cross_correlation(joint, keys, x, y, max_lag), keys, min_correlation=0.1
    ).drop("n_observations")
    steps = difference(joint, [x, y], 1, keys)
    chosen = joint.join(verdicts.where(~F.col("differenced")).select(*keys), keys).unionByName(
        steps.join(verdicts.where("differenced").select(*keys), keys)
    )
    granger = granger_bidirectional(chosen, keys, x, y, max_granger_lag, alpha)
    enough = F.col("n_observations") >= fixed.MIN_OBSERVATIONS
    return (
        sizes.join(verdicts, keys, "left").join(best, keys, "left")
        .join(granger.withColumnRenamed("relationship", "granger_relationship"), keys, "left")
        .withColumn("status", F.when(enough, "success").otherwise("error"))
    )
