"""Book metrics and percentile ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from bookheat import constants as C
from bookheat.functions import arrays as A
from bookheat.functions import linalg as L
from bookheat.session import broadcast_if_bounded, spread


MAX_BROADCAST_SYMBOLS = 50_000
#: Numbers of all vectors, one row per symbol, that go to the tasks with the function instead of with every position.
MAX_SHIPPED_NUMBERS = 4_000_000
#: Numbers of one window matrix that days are computed over at once.
CHUNK_NUMBERS = 1_000_000


def members(books: DataFrame, windowed: DataFrame, rolling: bool = True) -> DataFrame:
    """Positions with the window columns of their symbol, placed by book (and day).

    With ``rolling`` a book meets many days, so rows are placed by (book, day) after the join.
    For one day, books are placed first and the vectors, one row per symbol, come to them:
    broadcast when counted small, joined by key otherwise. Later grouping by book is shuffle-free.
    """
    if "items" in books.columns:
        books = books.select("book_id", F.inline("items"))
    own = books.select("book_id", "symbol", "weight")
    if rolling:
        return spread(own.join(windowed, "symbol"), "book_id", "t")
    return spread(own, "book_id").join(broadcast_if_bounded(windowed, MAX_BROADCAST_SYMBOLS), "symbol")


def shipped(vectors: DataFrame, cols: list[str]) -> dict | None:
    """``cols`` of ``vectors``, one row per symbol, as arrays in order of symbols; None if they are large or differ in length.

    They are counted before they are read.
    """
    lists = [f.name for f in vectors.schema if f.name in cols and isinstance(f.dataType, ArrayType)]
    sizes = [F.size(c) for c in lists]
    ends = [f(n) for n in sizes for f in (F.min, F.max)]
    n, numbers, *ends = vectors.agg(F.count("*"), F.sum(sum(sizes, F.lit(len(cols)))), *ends).first()
    if (numbers or 0) > MAX_SHIPPED_NUMBERS or any(lo != hi for lo, hi in zip(ends[::2], ends[1::2])):
        return None
    rows = sorted(vectors.select("symbol", *cols).collect(), key=lambda r: r.symbol.encode())
    kinds = {c: float if c in lists or not rows or isinstance(rows[0][c], float) else object for c in cols}
    return {"symbol": [r.symbol for r in rows], **{c: np.array([r[c] for r in rows], dtype=kinds[c]) for c in cols}}


def packed_books(books: DataFrame, **beside: Column) -> DataFrame:
    """(book_id, items): the positions of a book as one ordered list of symbol and weight.

    ``books`` may be packed already; then columns ``beside`` may follow from the row of a book.
    """
    if "items" in books.columns:
        items = F.transform("items", lambda e: F.struct(e["symbol"].alias("symbol"), e["weight"].alias("weight")))
        return books.select("book_id", items.alias("items"), *[c.alias(n) for n, c in beside.items()])
    own = spread(books.select("book_id", "symbol", "weight"), "book_id")
    return own.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "weight"))).alias("items"))


def map_books(books: DataFrame, vectors: DataFrame, cols: list[str], fn, out: str) -> DataFrame:
    """``fn`` on every book, its positions in order of symbols with ``cols`` of their vectors.

    Only symbols and weights are shuffled and packed. The vectors of a bounded universe reach a task once, with the
    function; those of a larger one are joined to the positions.
    """
    known = shipped(vectors, cols)
    if known is None:
        return L.map_groups(members(books, vectors, rolling=False), ["book_id"], ["symbol", "weight", *cols], fn, out, placed=True)
    place = {s: k for k, s in enumerate(known["symbol"])}

    def one(rec: dict) -> list[tuple]:
        own = [(place[s], k) for k, s in enumerate(rec["symbol"]) if s in place]
        if not own:
            return []
        at, k = (np.array(v) for v in zip(*own))
        names = [known["symbol"][i] for i in at]
        return fn({"symbol": names, "weight": rec["weight"][k], **{c: known[c][at] for c in cols}})

    return L.map_packed(packed_books(books), ["book_id"], one, out)


def moments(books: DataFrame, vectors: DataFrame) -> DataFrame:
    """(book_id, mu, v): mean and sample variance of every book's weighted return series; ``v`` is null for one value."""

    def one(rec: dict) -> list[tuple]:
        p = rec["weight"] @ rec["x"]
        return [(float(p.mean()), float(p.var(ddof=1)) if len(p) > 1 else None)]

    return map_books(books, vectors, ["x"], one, "mu double, v double")


def window_metrics(positions: DataFrame, span: int = C.EWMA_SPAN) -> DataFrame:
    """Absorption ratio, turbulence, diversification ratio, EWMA mean correlation and top pair.

    One packed row per (book, day); the matrix never leaves its task.
    """

    def one(rec: dict) -> list[tuple]:
        x, w, names = rec["x"], rec["weight"], rec["symbol"]
        n = len(names)
        avg, a, b, top = 0.0, None, None, 0.0
        if n >= 2:
            c = L.ewma_correlation(x, span)
            avg = float((c.sum() - n) / (n * (n - 1)))
            off = np.abs(c)
            np.fill_diagonal(off, 0.0)
            i, j = np.unravel_index(int(np.argmax(np.round(off, 12))), off.shape)
            a, b, top = names[i], names[j], float(c[i, j])
        return [
            (
                L.absorption_ratio(x),
                L.turbulence(x),
                L.diversification_ratio(x, w),
                avg,
                a,
                b,
                top,
                n,
            )
        ]

    return L.map_groups(
        positions,
        ["book_id", "t", "date"],
        ["symbol", "weight", "x"],
        one,
        "absorption_ratio double, turbulence double, div_ratio double, avg_corr double, "
        "pair_a string, pair_b string, top_corr double, n int",
        placed=True,
    )


def moments_by_day(x: np.ndarray, span: int = C.EWMA_SPAN) -> dict:
    """What ``shared_by_day`` takes from every day: ``x`` is (days, symbols, window). Matrices are (days, symbols, symbols)."""
    t, diag = x.shape[2], np.arange(x.shape[1])
    d = x - x.mean(axis=2, keepdims=True)
    gram = d @ d.transpose(0, 2, 1)
    k = (1 - 2.0 / (span + 1)) ** np.arange(t - 1, -1, -1)
    e = x - (x @ k / k.sum())[:, :, None]
    c = (e * k) @ e.transpose(0, 2, 1) / k.sum()
    s = np.sqrt(np.diagonal(c, axis1=1, axis2=2))
    s = np.where(s == 0, 1e-10, s)
    c = c / (s[:, :, None] * s[:, None, :])
    c[:, diag, diag] = 1.0
    off = np.round(np.abs(c), 12)
    off[:, diag, diag] = 0.0
    # around the mean of the days before the last, from the sums around the mean of all
    last = d[:, :, -1]
    gap = last * (t / max(t - 1, 1))
    hist = (gram - last[:, :, None] * gap[:, None, :]) / max(t - 2, 1) + 1e-8 * np.eye(len(diag))
    size = np.diagonal(gram, axis1=1, axis2=2).copy()
    return {"x": x, "d": d, "gram": gram / max(t - 1, 1), "corr": c, "off": off, "hist": hist, "gap": gap, "size": size}


def _of_symbols(m: dict, at: np.ndarray) -> dict:
    """The moments of the symbols on the places ``at`` alone; all of them in order are the moments themselves."""
    days, n = m["size"].shape
    if len(at) == n and (at == np.arange(n)).all():
        return m
    cell = (at[:, None] * n + at).ravel()
    square = {k: m[k].reshape(days, -1).take(cell, axis=1).reshape(days, len(at), len(at)) for k in ("gram", "corr", "off", "hist")}
    return {**m, **square, **{k: m[k].take(at, axis=1) for k in ("gap", "size")}}


def shared_by_day(m: dict, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``window_metrics`` of many days has from the symbols alone, for those on the places ``at`` of ``moments_by_day``.

    Gives absorption ratio, turbulence, mean correlation, places of the top pair and its correlation, an array of days
    each, and the deviations of every symbol, (days, positions).
    """
    days, n, t = len(m["x"]), len(at), m["x"].shape[2]
    own = _of_symbols(m, at)
    gram, size, gap = own["gram"], own["size"], own["gap"]
    corr, top = np.zeros(days), np.zeros(days)
    a = b = np.zeros(days, np.int64)
    if n >= 2:
        c = own["corr"]
        corr = (c.sum(axis=(1, 2)) - n) / (n * (n - 1))
        a, b = np.unravel_index(own["off"].reshape(days, -1).argmax(axis=1), (n, n))
        top = c[np.arange(days), a, b]
    ar = np.full(days, 0.5)
    if t >= 10 and n >= 3:
        total = size.sum(axis=1) / t
        d = m["d"].take(at, axis=1) if n > t else None
        small = gram if d is None else d.transpose(0, 2, 1) @ d / (t - 1)
        most = np.linalg.eigvalsh(small)[:, -max(1, n // 5) :].sum(axis=1)
        ar = np.clip(np.divide(most, total, out=ar, where=total > 0), 0.0, 1.0)
    turb = np.zeros(days)
    if t - 1 >= 30 and n >= 2:
        try:
            turb = np.maximum((gap * np.linalg.solve(own["hist"], gap[:, :, None])[:, :, 0]).sum(axis=1), 0.0)
        except np.linalg.LinAlgError:
            turb = np.array([L.turbulence(one) for one in m["x"].take(at, axis=1)])
    return ar, turb, corr, a, b, top, np.sqrt(size / max(t - 1, 1))


def window_sums(v: np.ndarray, window: int) -> np.ndarray:
    """Sums of every ``window`` neighbouring values of each row, from sums of 1, 2, 4, ... of them; nothing outside a window enters its sum."""
    count, out, at = v.shape[1] - window + 1, None, 0
    for bit in range(window.bit_length()):
        if window >> bit & 1:
            part = v[:, at : at + count]
            out, at = part.copy() if out is None else out + part, at + (1 << bit)
        if window >> bit > 1:
            v = v[:, : -(1 << bit)] + v[:, 1 << bit :]
    return out


def window_variances(v: np.ndarray, window: int) -> np.ndarray:
    """Sample variance of every ``window`` neighbouring values of each row; where sums of squares would lose digits, from the values themselves."""
    s, q = window_sums(v, window), window_sums(v * v, window)
    spread_of = q - s * s / window
    row, k = np.nonzero(~(spread_of >= 1e-4 * q))
    out = spread_of / (window - 1)
    step = max(1, CHUNK_NUMBERS // window)
    for lo in range(0, len(row), step):
        r, c = row[lo : lo + step], k[lo : lo + step]
        out[r, c] = np.var(v[r[:, None], c[:, None] + np.arange(window)], axis=1, ddof=1)
    return out


def ratios_by_day(x: np.ndarray, sd: np.ndarray, w: np.ndarray, window: int) -> np.ndarray:
    """Diversification ratios, (books, days), of books with the same symbols on every day with ``window`` values.

    ``x`` is (positions, values), ``sd`` (days, positions), ``w`` (books, positions).
    """
    out, gross = np.ones((len(w), len(sd))), np.abs(w).sum(axis=1)
    some = np.nonzero(gross > 0)[0]
    if len(x) >= 2 and window >= 20 and len(some):
        share = w[some] / gross[some, None]
        vol = np.sqrt(np.maximum(window_variances(share @ x, window), 1e-12))
        out[some] = np.maximum(np.abs(share) @ sd.T / vol, 1.0)
    return out


def diversification_ratio(books: DataFrame, windowed: DataFrame, rolling: bool = True) -> DataFrame:
    """Σ|w|σ over portfolio volatility, from the portfolio return series (no pairs)."""
    keys = ["book_id", "t"]
    vectors = A.with_centered(windowed, "x", "c").select(
        "t", "symbol", "c", F.size("x").alias("rows"), F.sqrt(A.dot(F.col("c"), F.col("c"))).alias("sd")
    )
    held = members(books, vectors, rolling)
    once, size = F.col("_k") == 0, F.abs("weight")
    per_step = (
        held.select(*keys, "weight", "rows", "sd", F.posexplode_outer("c").alias("_k", "_v"))
        .groupBy(*keys, "_k")
        .agg(
            F.sum(F.col("weight") * F.col("_v")).alias("p"),
            F.count("*").alias("n"),
            F.max("rows").alias("rows"),
            F.sum(F.when(once, size)).alias("gross"),
            F.sum(F.when(once, size * F.col("sd"))).alias("vols"),
        )
    )
    own = per_step.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("p")).alias("var"),
        F.max("n").alias("n"),
        F.max("rows").alias("rows"),
        F.max("gross").alias("gross"),
        F.max("vols").alias("vols"),
    )
    gross = F.col("gross")
    ratio = (F.col("vols") / gross) / F.sqrt(F.greatest(F.col("var") / (gross * gross), F.lit(1e-12)))
    neutral = (F.col("n") < 2) | (F.col("rows") < 20) | (gross == 0)
    return own.select(
        *keys, F.when(neutral, 1.0).otherwise(F.greatest(ratio, F.lit(1.0))).alias("div_ratio")
    )


def average_correlation(
    books: DataFrame, windowed: DataFrame, span: int = C.EWMA_SPAN, rolling: bool = True
) -> DataFrame:
    """EWMA mean pairwise correlation per (book, day), linear in positions."""
    from bookheat.operators.moments import avg_pairwise

    z = A.with_unit(A.with_ewma_centered(windowed, "x", "c", span), "c", "z").select("t", "symbol", "z")
    return avg_pairwise(members(books, z, rolling), ["book_id", "t"])


def inverse_dr(dr: Column) -> Column:
    return 1.0 / F.greatest(dr, F.lit(0.01))


def _history(value: Column | str, keys: list[str], order: str, lo: int, hi: int) -> Column:
    return F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(lo, hi))


def pct_rank_incl(value: str, keys: list[str], order: str, rows: int = C.HISTORY_ROWS) -> Column:
    """Share of the last ``rows`` values, current one included, that are <= the current value."""
    h = _history(value, keys, order, -(rows - 1), 0)
    rank = F.size(F.filter(h, lambda x: x <= F.col(value))) / F.size(h)
    return F.when(F.size(h) == 0, 0.5).otherwise(rank)


def pct_rank_excl(value: str, keys: list[str], order: str, rows: int = C.HISTORY_ROWS, more_than: int = 10) -> Column:
    """Share of previous values <= the current one; .5 until the history has more than ten values."""
    h = _history(value, keys, order, -(rows - 1), -1)
    rank = F.size(F.filter(h, lambda x: x <= F.col(value))) / F.size(h)
    return F.when(F.size(h) + 1 > more_than, rank).otherwise(0.5)


def inv_pct_rank_excl(
    value: str, keys: list[str], order: str, rows: int = C.HISTORY_ROWS, more_than: int = 5
) -> Column:
    """Share of previous values >= the current one; .5 until the history has more than five values."""
    h = _history(value, keys, order, -(rows - 1), -1)
    rank = F.size(F.filter(h, lambda x: x >= F.col(value))) / F.size(h)
    return F.when(F.size(h) + 1 > more_than, rank).otherwise(0.5)
