"""Volatility, dynamic correlation, regime and change-point models: one fit per key, keys in parallel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import fits
from bookheat.functions import linalg as L
from bookheat.session import spread


def garch(returns: DataFrame, value: str = "ret", min_obs: int = 100) -> DataFrame:
    """Per symbol and day: conditional volatility, standardised residual and parameters.

    Short series get EWMA volatility (span 60) with the fixed parameters 0, .05, .94.
    """

    def one(rec: dict) -> list[tuple]:
        t, y = rec["t"], rec[value]
        if len(y) >= min_obs and np.var(y) > 0:
            scaled = y * 100
            omega, a, b, v = fits.fit_garch(scaled)
            sigma = np.sqrt(v) / 100
            z = (y - y.mean()) / np.maximum(sigma, 1e-10)
        else:
            omega, a, b = 0.0, 0.05, 0.94
            sigma = np.full(len(y), np.nan)
            for i in range(1, len(y)):
                w = (1 - 2 / 61) ** np.arange(i, -1, -1)
                m = w @ y[: i + 1] / w.sum()
                bias = w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())
                sigma[i] = np.sqrt(w @ (y[: i + 1] - m) ** 2 / w.sum() * bias)
            z = y / np.maximum(sigma, 1e-10)
        return [
            (int(ti), float(s), float(zi), float(omega), float(a), float(b))
            for ti, s, zi in zip(t, sigma, z)
            if not np.isnan(s)
        ]

    return L.map_groups(
        returns, ["symbol"], ["t", value], one,
        "t int, sigma double, z double, omega double, alpha double, beta double",
    )


MIN_DCC_ROWS = 30


def dcc(books: DataFrame, residuals: DataFrame) -> DataFrame:
    """Dynamic conditional correlation per book: (book_id, a_param, b_param, a, b, correlation).

    A book's series meet on the days that all of them have. Each book is one row; its task scores the
    coarse likelihood grid and the one around its best point. Books with fewer than ``MIN_DCC_ROWS``
    common days get the EWMA correlation of these days and no parameters.
    """
    held = books.select("book_id", "symbol").join(residuals.select("symbol", "t", "z"), "symbol")
    names = held.groupBy("book_id").agg(F.count_distinct("symbol").alias("n")).filter("n >= 2")
    whole = held.groupBy("book_id", "t").agg(F.count("*").alias("m"))
    common = whole.join(names, "book_id").filter("m = n").select("book_id", "t")
    aligned = held.join(common, ["book_id", "t"])
    first = [(x / 100, y / 100) for x in range(1, 15, 2) for y in range(80, 99, 2) if x + y < 100]
    steps = [*(round(-0.02 + 0.005 * k, 3) for k in range(8)), 0.0]

    def best(z: np.ndarray, points: list[tuple[float, float]]) -> tuple[float, float, np.ndarray]:
        a, b = np.array(sorted(set(points))).T
        ll, corr = fits.dcc_scores(z, a, b)
        k = int(np.argmax(ll))
        return float(a[k]), float(b[k]), corr[k]

    def one(rec: dict) -> list[tuple]:
        symbols = sorted(set(rec["symbol"]))
        z = np.asarray(rec["z"], float).reshape(len(symbols), -1)
        if z.shape[1] < MIN_DCC_ROWS:
            a, b, corr = None, None, L.ewma_correlation(z, C.EWMA_SPAN)
        else:
            a, b, _ = best(z.T, first)
            near = [(max(a + x, 0.001), max(b + y, 0.5)) for x in steps for y in steps]
            a, b, corr = best(z.T, [(x, y) for x, y in near if x + y < 1])
        return [(a, b, symbols[i], symbols[j], float(corr[i, j])) for i in range(len(symbols)) for j in range(i + 1, len(symbols))]

    return L.map_groups(aligned, ["book_id"], ["symbol", "t", "z"], one, "a_param double, b_param double, a string, b string, correlation double")


FEATURES = ["rolling_return", "realized_vol", "return_skew", "avg_correlation", "heat_score"]


def regimes(features: DataFrame, lookback: int = 504, min_obs: int = 100) -> DataFrame:
    """Current regime per book from a three-state model of the newest ``lookback`` feature rows.

    (book_id, regime, regime_id, probabilities, confidence, transition_risk, is_fitted); books with
    too few rows get the neutral default.
    """

    def one(rec: dict) -> list[tuple]:
        x = np.column_stack([rec[c] for c in FEATURES])[-lookback:]
        default = [("unknown", -1, list(C.DEFAULT_REGIME_PROBABILITIES.values()), 0.34, 0.33, False)]
        if len(x) < min_obs:
            return default
        try:
            model = fits.fit_hmm(x)
            state, post = fits.hmm_state(x, model)
        except np.linalg.LinAlgError:
            return default
        return [
            (C.REGIMES[state], state, post.tolist(), float(post.max()), float(model[1][state, -1]), True)
        ]

    fitted = L.map_groups(
        features.withColumn("day", F.datediff("date", F.lit("1970-01-01"))),
        ["book_id"],
        ["day", *FEATURES],
        one,
        "regime string, regime_id int, probs array<double>, confidence double, transition_risk double, is_fitted boolean",
    )
    return fitted.withColumn(
        "probabilities", F.map_from_arrays(F.array(*[F.lit(s) for s in C.REGIMES]), F.col("probs"))
    ).drop("probs")


def change_points(series: DataFrame, keys: list[str], order: str, value: str, penalty: float = 10.0, min_size: int = 20) -> DataFrame:
    """(keys, position) of structural breaks in each series."""

    def one(rec: dict) -> list[tuple]:
        return [(int(p),) for p in fits.change_points(np.asarray(rec[value], dtype=float), penalty, min_size)]

    return L.map_groups(series.filter(F.col(value).isNotNull()), keys, [order, value], one, "position int")
