"""Direct computations on one series or pair of series, to hold the Gram-matrix operators against."""

import math

import numpy as np

from newsgauge.functions import inference as inf


def least_squares(y, x):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    residual = y - x @ beta
    return beta, float(residual @ residual)


def lags(series, order, n):
    end = len(series)
    return np.column_stack([series[end - n - k: end - k] for k in range(1, order + 1)]) if order else np.empty((n, 0))


def granger_p_values(x: np.ndarray, y: np.ndarray, max_lag: int) -> list[float] | None:
    """p-value of the F test that lags of x add nothing to lags of y, for every lag order."""
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    values = []
    for lag in range(1, max_lag + 1):
        n = len(y) - lag
        own = np.column_stack([np.ones(n), lags(y, lag, n)])
        joint = np.column_stack([own, lags(x, lag, n)])
        target = y[-n:]
        rss_own = least_squares(target, own)[1]
        rss_joint = least_squares(target, joint)[1]
        free = n - joint.shape[1]
        values.append(inf.f_tail((rss_own - rss_joint) / rss_joint / lag * free, lag, free)
                      if rss_joint > 0 else 0.0)
    return values


def fit_var(data: np.ndarray, max_lag: int) -> dict | None:
    """Lag order by AIC on the sample common to all orders, then the fit on its own sample."""
    total, k = data.shape

    def fit(order: int, n: int) -> tuple[np.ndarray, float, float]:
        parts = [np.ones((n, 1))] + [data[total - n - j: total - j] for j in range(1, order + 1)]
        x, y = np.hstack(parts), data[total - n:]
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        residual = y - x @ beta
        sign, logdet = np.linalg.slogdet(residual.T @ residual / n)
        free = order * k * k + k
        if sign <= 0:
            raise np.linalg.LinAlgError("singular residuals")
        return beta, logdet + 2 * free / n, logdet + math.log(n) * free / n

    try:
        order = min(range(max_lag + 1), key=lambda p: (fit(p, total - max_lag)[1], p))
        beta, aic, bic = fit(order, total - order)
    except np.linalg.LinAlgError:
        return None
    matrices = [beta[1 + j * k: 1 + (j + 1) * k].T.tolist() for j in range(order)]
    return {"order": order, "aic": aic, "bic": bic, "coefficients": matrices}


def unit_root_test(y: np.ndarray) -> tuple[float, float, int, int] | None:
    """Augmented regression with a constant; lag order by AIC on a common sample.

    Returns statistic, p-value, lags used, observations used; None for a constant series.
    """
    if len(y) < 4 or np.ptp(y) == 0:
        return None
    most = min(len(y) // 2 - 2, math.ceil(12 * (len(y) / 100) ** 0.25))
    if most < 0:
        return None
    step = np.diff(y)

    def design(order: int, n: int) -> np.ndarray:
        return np.column_stack([np.ones(n), y[-n - 1:-1], lags(step, order, n)])

    common = len(step) - most
    target, full = step[-common:], design(most, common)

    def aic(order: int) -> float:
        rss = least_squares(target, full[:, : order + 2])[1]
        return common * math.log(max(rss, 1e-300) / common) + 2 * (order + 2)

    order = min(range(most + 1), key=lambda k: (aic(k), k))
    n = len(step) - order
    x, target = design(order, n), step[-n:]
    beta, rss = least_squares(target, x)
    spread = rss / (n - x.shape[1]) * np.linalg.pinv(x.T @ x)[1, 1]
    if not spread > 0:
        return None
    tau = float(beta[1] / math.sqrt(spread))
    return tau, inf.unit_root_p(tau), order, n
