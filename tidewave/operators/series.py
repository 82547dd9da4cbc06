"""Time-series models of grouped series that fit a worker each: unit roots, autocorrelation, vector autoregression, causality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewave.operators.stats import chi2_upper, f_upper


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    return b, y - x @ b, inv


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    x = x - x.mean()
    total = float(x @ x)
    return np.array([float(x[k:] @ x[: len(x) - k]) / total if total else np.nan for k in range(min(lags, len(x) - 1) + 1)])


def partial_autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """By the Yule-Walker equations, with autocovariances over n - k."""
    x = x - x.mean()
    n = len(x)
    c = np.array([float(x[k:] @ x[: n - k]) / (n - k) for k in range(min(lags, n - 2) + 1)])
    out = [1.0]
    for k in range(1, len(c)):
        r = np.array([[c[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.lstsq(r, c[1 : k + 1], rcond=None)[0][-1]))
    return np.array(out)


def unit_root(x: np.ndarray, lags: int | None = None) -> tuple[float, int, bool]:
    """Augmented Dickey-Fuller with a constant: the statistic, the lags used (by AIC up to 12 (n/100)^1/4) and whether it passes the 5 % value."""
    n = len(x)
    most = int(np.ceil(12 * (n / 100) ** 0.25)) if lags is None else lags
    most = min(most, n // 2 - 2)
    dx = np.diff(x)

    def fit(p: int, start: int) -> tuple[float, float]:
        y = dx[start:]
        cols = [x[start:-1], *[dx[start - i : len(dx) - i] for i in range(1, p + 1)], np.ones(len(y))]
        z = np.column_stack(cols)
        b, e, inv = _ols(z, y)
        s2 = float(e @ e) / max(len(y) - z.shape[1], 1)
        aic = len(y) * np.log(max(float(e @ e) / len(y), 1e-300)) + 2 * z.shape[1]
        return float(b[0] / np.sqrt(max(s2 * inv[0, 0], 1e-300))), aic

    best = most if lags is not None else min(range(most + 1), key=lambda p: fit(p, most)[1])
    stat = fit(best, best)[0]
    m = len(dx) - best
    # Response surface of the 5 % critical value (constant, no trend).
    critical = -2.86154 - 2.8903 / m - 4.234 / m**2 - 40.04 / m**3
    return stat, best, stat < critical


class Autoregression:
    """A vector autoregression with constant, fitted by least squares equation by equation."""

    def __init__(self, data: np.ndarray, lags: int):
        n, k = data.shape
        self.k, self.p, self.n = k, lags, n - lags
        self.x = np.column_stack([np.ones(n - lags), *[data[lags - i : n - i] for i in range(1, lags + 1)]])
        self.y = data[lags:]
        self.b, self.e, self.inv = _ols(self.x, self.y)
        self.dof = self.n - self.x.shape[1]
        self.sigma = self.e.T @ self.e / max(self.dof, 1)

    @property
    def aic(self) -> float:
        sign, det = np.linalg.slogdet(self.e.T @ self.e / self.n)
        return det + 2 * self.k * self.x.shape[1] / self.n

    def responses(self, periods: int, orthogonal: bool = True) -> np.ndarray:
        """periods + 1 matrices: response of row variable to a shock in the column variable."""
        a = [self.b[1 + i * self.k : 1 + (i + 1) * self.k].T for i in range(self.p)]
        phi = [np.eye(self.k)]
        for h in range(1, periods + 1):
            phi.append(sum(phi[h - i] @ a[i - 1] for i in range(1, min(h, self.p) + 1)))
        root = np.linalg.cholesky(self.sigma + 1e-12 * np.eye(self.k)) if orthogonal else np.eye(self.k)
        return np.array([m @ root for m in phi])

    def causes(self, effect: int, cause: int) -> tuple[float, float]:
        """Wald F that no lag of `cause` helps to predict `effect`."""
        rows = [1 + i * self.k + cause for i in range(self.p)]
        b = self.b[rows, effect]
        v = self.inv[np.ix_(rows, rows)] * self.sigma[effect, effect]
        f = float(b @ np.linalg.pinv(v) @ b) / self.p
        return f, f_upper(f, self.p, self.k * self.dof)

    def whiteness(self, lags: int) -> tuple[float, float]:
        """Portmanteau statistic of the residuals' autocorrelation up to `lags`."""
        e = self.e - self.e.mean(0)
        c0 = np.linalg.pinv(e.T @ e / self.n)
        q = sum(np.trace((c := e[h:].T @ e[: self.n - h] / self.n).T @ c0 @ c @ c0) for h in range(1, lags + 1)) * self.n
        return float(q), chi2_upper(float(q), self.k**2 * max(lags - self.p, 1))

    def normality(self) -> tuple[float, float]:
        """Skewness and kurtosis of the orthogonalised residuals against the normal distribution."""
        e = self.e - self.e.mean(0)
        w = np.linalg.solve(np.linalg.cholesky(e.T @ e / self.n + 1e-12 * np.eye(self.k)), e.T)
        skew, kurt = (w**3).mean(1), (w**4).mean(1) - 3
        stat = float(self.n * (skew @ skew) / 6 + self.n * (kurt @ kurt) / 24)
        return stat, chi2_upper(stat, 2 * self.k)


def _series(pdf: pd.DataFrame, time: str, values: list[str]) -> np.ndarray:
    return pdf.sort_values(time)[values].to_numpy(float)


def unit_roots(df: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Per series: statistic, lags, stationary (at 5 %); series of fewer than 12 points have nulls."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _series(pdf, time, [value])[:, 0]
        stat, lags, ok = unit_root(x) if len(x) >= 12 and x.std() > 0 else (None, None, None)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "statistic": [stat], "lags": [lags], "stationary": [ok]})

    return df.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, statistic double, lags int, stationary boolean")


def correlograms(df: DataFrame, by: str, time: str, value: str, lags: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _series(pdf, time, [value])[:, 0]
        if len(x) < 3 or x.std() == 0:
            return pd.DataFrame({by: [], "lag": [], "acf": [], "pacf": []})
        a, p = autocorrelation(x, lags), partial_autocorrelation(x, lags)
        n = min(len(a), len(p))
        return pd.DataFrame({by: pdf[by].iloc[0], "lag": np.arange(n), "acf": a[:n], "pacf": p[:n]})

    return df.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, lag int, acf double, pacf double")


def causality(df: DataFrame, by: str, time: str, values: list[str], max_lags: int = 96) -> DataFrame:
    """Per group of series and ordered pair of them: lags (by AIC), F and p of Granger causality, and whiteness and normality of the residuals."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = _series(pdf, time, values)
        most = max(1, min(max_lags, (len(data) - 2) // (2 * len(values) + 1)))
        if len(data) < 3 * len(values) + 4:
            return pd.DataFrame(columns=cols)
        # All orders are compared on the same rows.
        lags = min(range(1, most + 1), key=lambda p: Autoregression(data[most - p :], p).aic)
        m = Autoregression(data, lags)
        white, normal = m.whiteness(lags + 5)[1], m.normality()[1]
        return pd.DataFrame([(pdf[by].iloc[0], c, e, lags, *m.causes(j, i), white, normal) for i, c in enumerate(values) for j, e in enumerate(values) if i != j], columns=cols)

    cols = [by, "cause", "effect", "lags", "f", "p", "p_white", "p_normal"]
    return df.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, cause string, effect string, lags int, f double, p double, p_white double, p_normal double")


def impulse_responses(df: DataFrame, by: str, time: str, values: list[str], lags: int, periods: int = 96) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = Autoregression(_series(pdf, time, values), lags).responses(periods)
        return pd.DataFrame([(pdf[by].iloc[0], values[j], values[i], h, float(r[h, i, j])) for h in range(len(r)) for i in range(len(values)) for j in range(len(values))], columns=[by, "shock", "response", "period", "value"])

    return df.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, shock string, response string, period int, value double")
