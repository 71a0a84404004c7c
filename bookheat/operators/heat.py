"""Composite heat score per (book, day)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bookheat import constants as C
from bookheat.functions import linalg as L
from bookheat.functions import rules as R
from bookheat.operators import factors as X
from bookheat.operators import metrics as M
from bookheat.operators import panel as P
from bookheat.session import broadcast_if_bounded, rounded

MAX_BROADCAST_DAYS = 50_000
RANKS = {
    "ar_pct": "absorption_ratio",
    "turbulence_pct": "turbulence",
    "div_ratio_pct": "inv_dr",
    "factor_hhi_pct": "factor_hhi",
    "avg_corr_pct": "avg_corr",
}


def components(books: DataFrame, windowed: DataFrame, factors: DataFrame) -> DataFrame:
    """The five raw components, dominant factor and top pair per (book, day)."""
    raw = M.window_metrics(M.members(books, windowed))
    hhi = X.factor_hhi(X.aggregate_exposures(X.factor_exposures(windowed, factors), books))
    return join_components(raw, hhi)


def join_components(raw: DataFrame, hhi: DataFrame) -> DataFrame:
    """Window metrics and factor concentration on one row per (book, day)."""
    return raw.join(hhi, ["book_id", "t"], "left").select(
        "book_id",
        "t",
        "date",
        "absorption_ratio",
        "turbulence",
        "div_ratio",
        F.coalesce("factor_hhi", F.lit(0.0)).alias("factor_hhi"),
        "avg_corr",
        F.coalesce("dominant_factor", F.lit("none")).alias("dominant_factor"),
        F.concat_ws("-", "pair_a", "pair_b").alias("top_pair"),
        "top_corr",
    )


def once_per_date(df: DataFrame, arrival: str) -> DataFrame:
    """Keep the first row to arrive for each (book, data date)."""
    w = Window.partitionBy("book_id", "date").orderBy(arrival)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def blend(parts: DataFrame, history: DataFrame | None = None, rows: int = C.HISTORY_ROWS) -> DataFrame:
    """Percentile-rank the components in each book's history and blend them to [0, 1].

    ``history`` (same columns) extends the ranks backwards; its rows are not returned.
    """
    df = parts.withColumn("_keep", F.lit(True))
    if history is not None:
        df = df.unionByName(history.select(*parts.columns).withColumn("_keep", F.lit(False)))
    df = df.withColumn("inv_dr", M.inverse_dr(F.col("div_ratio")))
    for out, col in RANKS.items():
        df = df.withColumn(out, M.pct_rank_incl(col, ["book_id"], "date", rows))
    return _scored(df.filter("_keep")).drop("_keep", "inv_dr")


def _scored(df: DataFrame) -> DataFrame:
    """Adds score, level and action to rows with the five ranks."""
    w = C.HEAT_WEIGHTS
    score = (
        w["ar"] * F.col("ar_pct")
        + w["turb"] * F.col("turbulence_pct")
        + w["dr"] * F.col("div_ratio_pct")
        + w["hhi"] * F.col("factor_hhi_pct")
        + w["corr"] * F.col("avg_corr_pct")
    )
    return (
        df.withColumn("score", R.clip(score, 0.0, 1.0))
        .withColumn("level", R.classify_heat(F.col("score")))
        .withColumn("action", R.heat_action(F.col("level")))
    )


def rolling_heat(books: DataFrame, returns: DataFrame, factors: DataFrame, window: int = C.WINDOW_ROWS) -> DataFrame:
    """Heat for every day that has ``window`` earlier rows; the labelled day is not in its window."""
    return blend(components(books, P.windows(returns, "simple", window, include_current=False), factors))


def _slopes(series: np.ndarray, window: int) -> np.ndarray:
    """Matrices that take the ``window`` values before each day to their slopes on the factor ``series``."""
    days = np.lib.stride_tricks.sliding_window_view(series[:, :-1], window, axis=1).transpose(1, 2, 0)
    design = np.concatenate([np.ones((*days.shape[:2], 1)), days], axis=2)
    across = design.transpose(0, 2, 1)
    return (np.linalg.pinv(across @ design) @ across)[:, 1:]


def _series(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """(symbol, x, factor): the whole return series of every symbol."""
    return (
        returns.groupBy("symbol")
        .agg(F.array_sort(F.collect_list(F.struct("t", "simple"))).alias("s"))
        .select("symbol", F.transform("s", lambda e: e["simple"]).alias("x"))
        .join(F.broadcast(factors), "symbol", "left")
    )


def _day_windows(x: np.ndarray, window: int) -> np.ndarray:
    """The ``window`` values before each day, (days, symbols, window)."""
    return np.lib.stride_tricks.sliding_window_view(x[:, :-1], window, axis=1).transpose(1, 0, 2)


def _day_moments(x: np.ndarray, window: int) -> dict | None:
    """Moments of all symbols on all days, for sets to take their own from; None if they are many numbers or without days."""
    days, n = x.shape[1] - window, len(x)
    if days < 1 or days * n * max(n, window) > M.CHUNK_NUMBERS:
        return None
    return M.moments_by_day(_day_windows(x, window))


def _betas(x: np.ndarray, slopes: np.ndarray | None, window: int) -> np.ndarray | None:
    """Slopes of every symbol on every factor and day, (symbols, factors * days); None if they are many numbers or without days."""
    if slopes is None or x.shape[1] <= window or len(x) * slopes.shape[0] * slopes.shape[1] > M.CHUNK_NUMBERS:
        return None
    return (_day_windows(x, window) @ slopes.transpose(0, 2, 1)).transpose(1, 2, 0).reshape(len(x), -1)


def _set_days(
    x: np.ndarray, plain: np.ndarray, window: int, slopes, moments: dict | None = None, at: np.ndarray | None = None,
    betas: np.ndarray | None = None,
):
    """What books that hold exactly the symbols of ``x`` have on every day; None without days.

    Gives {column: array of days} of what the symbols alone decide, with the places ``a``, ``b`` of the top pair, and a
    function from weights (books, positions) to the columns that depend on them, (books, days) each; ``dominant`` is the place
    of a factor, -1 for none. ``moments`` and ``betas`` are those of all symbols, of which the set is on the places ``at``.
    """
    days = x.shape[1] - window
    if days < 1:
        return None
    if moments is not None:
        ar, turb, corr, a, b, top, sd = M.shared_by_day(moments, at)
    else:
        seen, every = _day_windows(x, window), np.arange(len(x))
        step = max(1, M.CHUNK_NUMBERS // (len(x) * max(len(x), window)))
        cut = [M.shared_by_day(M.moments_by_day(seen[lo : lo + step]), every) for lo in range(0, days, step)]
        ar, turb, corr, a, b, top, sd = (np.concatenate(c) for c in zip(*cut))
    shared = {"absorption_ratio": ar, "turbulence": turb, "avg_corr": corr, "top_corr": top, "a": a, "b": b}
    own_betas = betas[at[plain]] if betas is not None else None

    def of(w: np.ndarray) -> dict[str, np.ndarray]:
        hhi, dominant = np.zeros((len(w), days)), np.full((len(w), days), -1)
        if plain.any() and slopes is not None:
            if own_betas is not None:
                size = np.abs(w[:, plain] @ own_betas).reshape(len(w), -1, days)
            else:
                held = np.lib.stride_tricks.sliding_window_view((w[:, plain] @ x[plain])[:, :-1], window, axis=1)
                size = np.abs(slopes @ held.transpose(1, 2, 0)).transpose(2, 1, 0)
            total = size.sum(axis=1)
            hhi = np.divide((size**2).sum(axis=1), total**2, out=hhi, where=total > 0)
            most, dominant = size[:, 0], np.zeros((len(w), days), np.int64)
            for k in range(1, size.shape[1]):
                dominant[size[:, k] >= most] = k
                most = np.maximum(most, size[:, k])
        return {"div_ratio": M.ratios_by_day(x[:, :-1], sd, w, window), "factor_hhi": hhi, "dominant": dominant}

    return shared, of


def _set_history(
    x: np.ndarray, plain: np.ndarray, window: int, rows: int, names: list[str], slopes, symbols: list[str],
    moments: dict | None = None, at: np.ndarray | None = None,
):
    """Function from weights (books, positions) to the days of books that hold exactly ``symbols``; None without days.

    The function gives {column: (books, days) array} with ranks and names; columns of one row hold for every book.
    """
    made = _set_days(x, plain, window, slopes, moments, at)
    if made is None:
        return None
    shared, of = made
    pair = [f"{symbols[i]}-{symbols[j]}" if i != j else "" for i, j in zip(shared["a"], shared["b"])]
    fixed = {k: shared[k][None, :] for k in ("absorption_ratio", "turbulence", "avg_corr", "top_corr")}
    fixed |= {k: L.pct_ranks_incl(fixed[v], rows) for k, v in RANKS.items() if v in fixed} | {"top_pair": np.array(pair, dtype=object)[None, :]}

    def whole(w: np.ndarray) -> dict[str, np.ndarray]:
        own = of(w)
        dominant = np.array([*names, "none"], dtype=object)[own.pop("dominant")]
        own |= {"div_ratio_pct": L.pct_ranks_incl(_inverse(own["div_ratio"]), rows), "factor_hhi_pct": L.pct_ranks_incl(own["factor_hhi"], rows)}
        return fixed | own | {"dominant_factor": dominant}

    return whole


def _inverse(dr: np.ndarray) -> np.ndarray:
    return 1.0 / np.maximum(dr, 0.01)


class _Days:
    """Every day of some books: columns that the symbols decide, one row per set, and columns of the books themselves."""

    def __init__(self, pieces: list[tuple[dict, dict, np.ndarray]], symbols: list[str], names: list[str], window: int, rows: int):
        self.symbols, self.names, self.window, self.rows = symbols, names, window, rows
        sets = {id(p[0]): p for p in pieces}
        number = {k: i for i, k in enumerate(sets)}
        self.of_set = {k: np.stack([p[0][k] for p in sets.values()]) for k in pieces[0][0]}
        # places of the top pair among all symbols
        self.of_set |= {k: np.stack([p[2][p[0][k]] for p in sets.values()]) for k in ("a", "b")}
        self.of_book = {k: np.concatenate([p[1][k] for p in pieces]) for k in pieces[0][1]}
        self.set_of = np.repeat([number[id(p[0])] for p in pieces], [len(p[1]["div_ratio"]) for p in pieces])
        self.books, self.days = self.of_book["div_ratio"].shape

    def reported(self, name: str, digits: int) -> np.ndarray:
        """``lists`` rounded; what a set decides is rounded once for its books."""
        return L.rounded(self.of_set[name], digits)[self.set_of] if name in self.of_set else L.rounded(self.of_book[name], digits)

    def scores(self) -> np.ndarray:
        """(books, days) of the score, summed in the order of ``_scored``."""
        w, rank = C.HEAT_WEIGHTS, lambda v: L.pct_ranks_incl(v, self.rows)
        score = (w["ar"] * rank(self.of_set["absorption_ratio"]) + w["turb"] * rank(self.of_set["turbulence"]))[self.set_of]
        score = score + w["dr"] * rank(_inverse(self.of_book["div_ratio"])) + w["hhi"] * rank(self.of_book["factor_hhi"])
        return np.clip(score + (w["corr"] * rank(self.of_set["avg_corr"]))[self.set_of], 0.0, 1.0)

    def lists(self, name: str) -> np.ndarray:
        """(books, days) of one component."""
        return self.of_set[name][self.set_of] if name in self.of_set else self.of_book[name]

    def at(self, book: np.ndarray, day: np.ndarray, schema: pa.Schema) -> list[pa.Array]:
        """Columns of ``schema`` on the given places of (book, day)."""
        one, cols = self.set_of[book], []
        for f in schema:
            ranked = RANKS.get(f.name, "")
            name = ranked or f.name
            value, row = (self.of_set, one) if name in self.of_set else (self.of_book, book)
            if f.name == "t":
                v = day + self.window
            elif f.name == "top_pair":
                n, a, b = len(self.symbols), self.of_set["a"][one, day], self.of_set["b"][one, day]
                code, v = np.unique(a * n + b, return_inverse=True)
                v = pa.array([f"{self.symbols[c // n]}-{self.symbols[c % n]}" if c // n != c % n else "" for c in code.tolist()]).take(pa.array(v))
            elif f.name == "dominant_factor":
                v = self.of_book["dominant"][book, day]
                v = pa.array([*self.names, "none"]).take(pa.array(np.where(v < 0, len(self.names), v)))
            elif ranked:
                v = L.pct_ranks_at(_inverse(self.of_book["div_ratio"]) if ranked == "inv_dr" else value[name], book if ranked == "inv_dr" else row, day, self.rows)
            else:
                v = value[name][row, day]
            cols.append(v if isinstance(v, pa.Array) else pa.array(v, f.type))
        return cols


_HISTORY = (
    "t int, absorption_ratio double, turbulence double, div_ratio double, factor_hhi double, avg_corr double, "
    f"dominant_factor string, top_pair string, top_corr double, {', '.join(f'{c} double' for c in RANKS)}"
)
_NAMED = ("dominant_factor", "top_pair", "top_corr")
_LISTS = {"h_ar": "absorption_ratio", "h_turb": "turbulence", "h_dr": "div_ratio", "h_hhi": "factor_hhi", "h_corr": "avg_corr"}


def _histories(packed: DataFrame, known: dict, slopes, names: list[str], window: int, rows: int, out: str, emit) -> DataFrame:
    """``emit(days, batch, schema)`` over the days of all books of ``packed``, books with the same symbols side by side.

    Rows are ordered by their symbols, so a task computes what the symbols alone decide once for a run of books that hold
    the same, and a set that many books hold is spread over tasks. Books are handed on, and ranked, many at a time.
    """
    spark = packed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # equal sets have equal hashes; two sets that share one only cost a second computation
    sets = packed.withColumn("_set", F.xxhash64(F.transform("items", lambda e: e["symbol"])))
    sets = sets.repartitionByRange(parts, "_set", "book_id").sortWithinPartitions("_set").drop("_set")
    out_schema = StructType([packed.schema["book_id"], *L.schema_of(out).fields])
    schema = to_arrow_schema(out_schema)
    symbols, plain = known["symbol"], np.array([f is None for f in known["factor"]])
    place = {s: k for k, s in enumerate(symbols)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        moments = _day_moments(known["x"], window) if len(symbols) else None
        betas = _betas(known["x"], slopes, window) if len(symbols) else None
        step = max(1, M.CHUNK_NUMBERS // (max(window, len(names)) * max(1, known["x"].shape[1]))) if len(symbols) else 1
        for batch in batches:
            items = batch.column(batch.schema.get_field_index("items"))
            offsets, structs = items.offsets.to_numpy(), items.values
            names_of = structs.field("symbol").to_pylist()
            weight = structs.field("weight").to_numpy(zero_copy_only=False)
            codes = np.array([place.get(s, -1) for s in names_of], dtype=np.int64)
            keys = [codes[lo:hi][codes[lo:hi] >= 0].tobytes() for lo, hi in zip(offsets, offsets[1:])]
            pieces, taken, held, lo = [], [], 0, 0
            while lo < len(keys):
                if keys[lo] != last:
                    last, at = keys[lo], np.frombuffer(keys[lo], np.int64)
                    of = _set_days(known["x"][at], plain[at], window, slopes, moments, at, betas) if len(at) else None
                hi = lo + 1
                while hi < len(keys) and hi - lo < step and keys[hi] == last:
                    hi += 1
                if of is not None:
                    flat = weight[offsets[lo] : offsets[hi]][codes[offsets[lo] : offsets[hi]] >= 0]
                    pieces.append((of[0], of[1](flat.reshape(hi - lo, -1)), at))
                    taken.extend(range(lo, hi))
                    held += (hi - lo) * (known["x"].shape[1] - window)
                lo = hi
                if pieces and (held >= L.ROWS_AT_ONCE or lo == len(keys)):
                    yield emit(_Days(pieces, symbols, names, window, rows), batch.take(pa.array(taken)), schema)
                    pieces, taken, held = [], [], 0

    return sets.mapInArrow(run, out_schema)


def _start(returns: DataFrame, factors: DataFrame, window: int):
    """(series, series as arrays or None, slopes, factor names) of all symbols."""
    vectors = _series(returns, factors)
    block = sorted((f.factor, f.x) for f in vectors.filter("factor is not null").collect())
    slopes = _slopes(np.array([x for _, x in block]), window) if block and len(block[0][1]) > window else None
    return vectors, M.shipped(vectors, ["x", "factor"]), slopes, [f for f, _ in block]


def _book_ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("book_id"))


def own_history(
    books: DataFrame, returns: DataFrame, factors: DataFrame, window: int = C.WINDOW_ROWS, rows: int = C.HISTORY_ROWS,
    asked: DataFrame | Column | None = None, named: bool = True,
) -> DataFrame:
    """``rolling_heat`` for many books: every day of a book from one packed row, ranks included.

    A book's exposures are the slopes of its weighted returns, so the factor regression of a day is solved once for all
    books and symbols. With ``asked`` (book_id, date) only a book's newest day and its last days up to the dates asked for
    are returned; where ``books`` are packed it may be the list of dates that follows from the row of a book. Without ``named`` no
    dominant factor and top pair.
    """
    vectors, known, slopes, names = _start(returns, factors, window)
    days = returns.select("t", "date").distinct()
    if known is None:
        made = _joined_history(books, vectors, slopes, names, window, rows).drop(*[] if named else _NAMED)
        scored = _scored(made.join(broadcast_if_bounded(days, MAX_BROADCAST_DAYS), "t"))
        if isinstance(asked, Column):
            asked = books.select("book_id", F.explode(asked).alias("date"))
        return scored if asked is None else _asked_days(scored, asked)
    if isinstance(asked, Column):
        packed = M.packed_books(books, asked=asked)
    else:
        packed = M.packed_books(books)
    dates, every = [r.date for r in days.orderBy("t").collect()], asked is None
    if isinstance(asked, DataFrame):
        packed = packed.join(asked.groupBy("book_id").agg(F.collect_set("date").alias("asked")), "book_id", "left")

    def emit(made: _Days, batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        n, count = made.books, made.days
        if every:
            book, day = np.repeat(np.arange(n), count), np.tile(np.arange(count), n)
        else:
            wanted = batch.column(batch.schema.get_field_index("asked")).to_pylist()
            rows_of = [{bisect_right(dates, d) - 1 - window for d in w or () if d is not None} | {count - 1} for w in wanted]
            pairs = [(g, k) for g, found in enumerate(rows_of) for k in sorted(found) if k >= 0]
            book, day = (np.array(v, dtype=np.int64) for v in zip(*pairs))
        cols = made.at(book, day, pa.schema(list(schema)[1:]))
        return pa.RecordBatch.from_arrays([_book_ids(batch).take(pa.array(book)), *cols], schema=schema)

    out = ", ".join(c for c in _HISTORY.split(", ") if named or c.split()[0] not in _NAMED)
    made = _histories(packed, known, slopes, names, window, rows, out, emit)
    return _scored(made.join(broadcast_if_bounded(days, MAX_BROADCAST_DAYS), "t"))


def reported_history(
    books: DataFrame, returns: DataFrame, factors: DataFrame, digits: dict[str, int], window: int = C.WINDOW_ROWS, rows: int = C.HISTORY_ROWS
) -> DataFrame:
    """(book_id, date, *digits, level): ``own_history`` for reporting, dates as text and numbers rounded to ``digits``.

    Rows leave the function that makes them as they are reported: ranks are not handed on, and what the symbols decide is ranked and
    rounded once for all books of a batch that hold them.
    """
    _, known, slopes, names = _start(returns, factors, window)
    if known is None:
        made = own_history(books, returns, factors, window, rows, named=False)
        return made.select("book_id", F.col("date").cast("string").alias("date"), *[rounded(c, d).alias(c) for c, d in digits.items()], "level")
    dates = pa.array([str(r.date) for r in returns.select("t", "date").distinct().orderBy("t").collect()], pa.string())
    ladder = sorted(C.THRESHOLDS.items(), key=lambda e: e[1])
    levels, ends = pa.array(["cool", *[k for k, _ in ladder]]), np.array([v for _, v in ladder])

    def emit(made: _Days, batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        n, count, score = made.books, made.days, made.scores()
        of = {"score": L.rounded(score, digits["score"])} if "score" in digits else {}
        of |= {c: made.reported(c, d) for c, d in digits.items() if c != "score"}
        cols = [
            _book_ids(batch).take(pa.array(np.repeat(np.arange(n), count))),
            dates.take(pa.array(np.tile(np.arange(window, window + count), n))),
            *[pa.array(of[c].ravel()) for c in digits],
            levels.take(pa.array(np.searchsorted(ends, score.ravel(), side="right"))),
        ]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    out = f"date string, {', '.join(f'{c} double' for c in digits)}, level string"
    return _histories(M.packed_books(books), known, slopes, names, window, rows, out, emit)


def own_component_lists(
    books: DataFrame, returns: DataFrame, factors: DataFrame, window: int = C.WINDOW_ROWS, rows: int = C.HISTORY_ROWS
) -> DataFrame:
    """``component_history`` of every book: one row with its last ``rows`` values of every component."""
    from bookheat.operators.actions import component_history

    vectors, known, slopes, names = _start(returns, factors, window)
    if known is None:
        return component_history(_joined_history(books, vectors, slopes, names, window, rows), rows)

    def emit(made: _Days, batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        n, cols = made.books, []
        for name in schema.names[1:]:
            v = made.lists(_LISTS[name])[:, -rows:]
            v = _inverse(v) if name == "h_dr" else v
            cols.append(pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * v.shape[1], v.ravel()).cast(schema.field(name).type))
        return pa.RecordBatch.from_arrays([_book_ids(batch), *cols], schema=schema)

    out = ", ".join(f"{c} array<double>" for c in _LISTS)
    return _histories(M.packed_books(books), known, slopes, names, window, rows, out, emit)


def _joined_history(books: DataFrame, vectors: DataFrame, slopes, names: list[str], window: int, rows: int) -> DataFrame:
    """The days of every book where series are too large to go with the function: a series is joined to every position."""
    fields = [c.split()[0] for c in _HISTORY.split(", ")]

    def one(rec: dict) -> list[tuple]:
        plain = np.array([f is None for f in rec["factor"]])
        of = _set_history(rec["x"], plain, window, rows, names, slopes, rec["symbol"])
        if of is None:
            return []
        made = of(rec["weight"][None, :])
        days = made["absorption_ratio"].shape[1]
        made["t"] = np.arange(window, window + days)[None, :]
        return list(zip(*[np.broadcast_to(made[c], (1, days))[0].tolist() for c in fields]))

    cols = ["symbol", "weight", "x", "factor"]
    return L.map_groups(M.members(books, vectors, rolling=False), ["book_id"], cols, one, _HISTORY, placed=True)


def _asked_days(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """The newest row of every book and its last rows up to the dates asked for."""
    row = F.struct(*[F.col(c) for c in scored.columns if c != "book_id"])
    newest = scored.groupBy("book_id").agg(F.max_by(row, "t").alias("r"))
    upto = scored.join(asked.select("book_id", F.col("date").alias("_asked")).distinct(), "book_id").filter("date <= _asked")
    found = upto.groupBy("book_id", "_asked").agg(F.max_by(row, "t").alias("r")).drop("_asked")
    return newest.unionByName(found).select("book_id", "r.*").distinct().select(scored.columns)


def latest_components(books: DataFrame, returns: DataFrame, factors: DataFrame, window: int) -> DataFrame:
    """Components of every book at the newest date, window including that date."""
    newest = returns.agg(F.max("t")).scalar()
    recent = returns.filter(F.col("t") > newest - window)
    return components(books, P.windows(recent, "ret", window, include_current=True), factors)
