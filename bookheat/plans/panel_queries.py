"""Registered queries: sources, panels and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookheat.operators import books as B
from bookheat.operators import panel as P
from bookheat.plans import model_sql  # noqa: F401  (defines the CTEs)
from bookheat.plans.oracle import with_ctes
from bookheat.plans.registry import query
from bookheat.session import rounded as r
from bookheat.sources import tables as T


def text(col: str):
    return F.col(col).cast("string").alias(col)


@query(
    "log_returns",
    with_ctes(
        "rets",
        """SELECT CAST(t AS BIGINT) AS t, CAST(date AS VARCHAR) AS date, symbol, round(ret, 6) + 0.0 AS ret,
       round(simple, 6) + 0.0 AS simple FROM rets""",
    ),
)
def log_returns(spark, sf):
    return P.log_returns(T.closes(spark, sf)).select(
        F.col("t").cast("bigint").alias("t"), text("date"), "symbol", r("ret").alias("ret"), r("simple").alias("simple")
    )


@query(
    "log_returns_last_period",
    with_ctes(
        "rets",
        """SELECT symbol, count(*) AS n, round(sum(ret), 6) + 0.0 AS total FROM rets
WHERE t > (SELECT max(t) FROM rets) - 252 GROUP BY 1""",
    ),
)
def log_returns_last_period(spark, sf):
    return (
        P.log_returns(T.closes(spark, sf), period=252)
        .groupBy("symbol")
        .agg(F.count("*").alias("n"), r(F.sum("ret")).alias("total"))
    )


@query(
    "ffill_closes",
    with_ctes(
        "closes",
        """SELECT CAST(d.date AS VARCHAR) AS date, s.symbol, round(c.close, 6) + 0.0 AS close
FROM (SELECT DISTINCT date FROM closes) d CROSS JOIN (SELECT DISTINCT symbol FROM closes) s
ASOF JOIN closes c ON c.symbol = s.symbol AND d.date >= c.date""",
    ),
)
def ffill_closes(spark, sf):
    return P.forward_fill_closes(T.closes(spark, sf)).select(text("date"), "symbol", r("close").alias("close"))


@query(
    "close_prices",
    with_ctes(
        "closes",
        """SELECT CAST(date AS VARCHAR) AS date, symbol, round(close, 6) + 0.0 AS close FROM closes
WHERE date IN (SELECT date FROM closes GROUP BY date HAVING count(close) > 0)""",
    ),
)
def close_prices(spark, sf):
    return P.close_prices(T.closes(spark, sf)).select(text("date"), "symbol", r("close").alias("close"))


_BARS = """SELECT symbol, date_trunc('day', ts) AS bar_start, arg_min(price, (ts, seq)) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(size) AS volume,
       sum(price * size) / sum(size) AS vwap
FROM ticks GROUP BY 1, 2"""
model_sql.define("bars", _BARS, "ticks")


def _bars(spark, sf):
    return P.ohlcv_bars(T.ticks(spark, sf), "1 day")


@query(
    "ohlcv_bars",
    with_ctes(
        "bars",
        """SELECT symbol, strftime(bar_start, '%Y-%m-%d') AS bar_start, open, high, low, close,
       CAST(volume AS DOUBLE) AS volume, round(vwap, 6) + 0.0 AS vwap FROM bars""",
    ),
)
def ohlcv_bars(spark, sf):
    return _bars(spark, sf).select(
        "symbol",
        F.date_format("bar_start", "yyyy-MM-dd").alias("bar_start"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        r("vwap").alias("vwap"),
    )


@query(
    "returns_from_bars",
    with_ctes(
        "bars",
        """SELECT symbol, CAST(CAST(bar_start AS DATE) AS VARCHAR) AS date, round(ln(close / p), 6) + 0.0 AS ret
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_start) AS p,
             count(*) OVER (PARTITION BY bar_start) AS n,
             lag(bar_start) OVER (PARTITION BY symbol ORDER BY bar_start) AS pb FROM bars) b
JOIN (SELECT bar_start AS d, lag(bar_start) OVER (ORDER BY bar_start) AS pd, c, lag(c) OVER (ORDER BY bar_start) AS pc
      FROM (SELECT bar_start, count(*) AS c FROM bars GROUP BY 1)) g ON g.d = b.bar_start
WHERE g.c = (SELECT count(DISTINCT symbol) FROM bars) AND g.pc = g.c""",
    ),
)
def returns_from_bars(spark, sf):
    closes = _bars(spark, sf).select(F.to_date("bar_start").alias("date"), "symbol", "close")
    return P.log_returns(closes).select("symbol", text("date"), r("ret").alias("ret"))


@query(
    "latest_snapshot",
    with_ctes(
        "bars",
        """SELECT symbol, close AS price, open, high, low, CAST(volume AS DOUBLE) AS volume, p AS prev_close,
       round(CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE close - p END, 6) + 0.0 AS change,
       round(CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE (close - p) / p * 100 END, 6) + 0.0 AS change_pct
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_start) AS p,
             row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) AS rn FROM bars) WHERE rn = 1""",
    ),
)
def latest_snapshot(spark, sf):
    return P.latest_snapshot(_bars(spark, sf)).select(
        "symbol", "price", "open", "high", "low", "volume", "prev_close",
        r("change").alias("change"), r("change_pct").alias("change_pct"),
    )


@query(
    "macro_panel_ffill",
    with_ctes(
        "macro",
        """SELECT CAST(date AS VARCHAR) AS date, round(u, 4) + 0.0 AS urgent, round(h, 4) + 0.0 AS high,
       round(m, 4) + 0.0 AS medium, round(n, 4) + 0.0 AS unspecified, round(l, 4) + 0.0 AS low,
       round(u - l, 4) + 0.0 AS spread
FROM (SELECT date, last_value(u IGNORE NULLS) OVER w AS u, last_value(h IGNORE NULLS) OVER w AS h,
             last_value(m IGNORE NULLS) OVER w AS m, last_value(n IGNORE NULLS) OVER w AS n,
             last_value(l IGNORE NULLS) OVER w AS l
      FROM (SELECT date, max(value) FILTER (series_id = '1-URGENT') AS u, max(value) FILTER (series_id = '2-HIGH') AS h,
                   max(value) FILTER (series_id = '3-MEDIUM') AS m,
                   max(value) FILTER (series_id = '4-NOT SPECIFIED') AS n,
                   max(value) FILTER (series_id = '5-LOW') AS l FROM macro GROUP BY date)
      WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
WHERE coalesce(u, h, m, n, l) IS NOT NULL""",
    ),
)
def macro_panel_ffill(spark, sf):
    ids = list(T.MACRO_SERIES)
    wide = P.macro_panel(T.macro(spark, sf), ids, ids[0], ids[-1])
    names = ["urgent", "high", "medium", "unspecified", "low"]
    return wide.select(
        text("date"), *[r(F.col(f"`{i}`"), 4).alias(n) for i, n in zip(ids, names)], r("spread", 4).alias("spread")
    )


@query(
    "resolve_source",
    with_ctes(
        ["source_closes", "source_priority"],
        """, cov AS (SELECT date, source, count(DISTINCT symbol) AS n FROM source_closes GROUP BY 1, 2),
pick AS (SELECT date, coalesce(arg_min(source, priority) FILTER (ok), arg_min(source, priority)) AS source,
                NOT bool_or(ok) AS stale
         FROM (SELECT cov.*, priority, n >= 0.5 * (SELECT count(DISTINCT p_brand) FROM part) AS ok
               FROM cov JOIN source_priority USING (source)) GROUP BY date)
SELECT CAST(q.date AS VARCHAR) AS date, q.symbol, q.source, p.stale, round(q.close, 6) + 0.0 AS close
FROM source_closes q JOIN pick p ON q.date = p.date AND q.source = p.source""",
    ),
)
def resolve_source(spark, sf):
    n = T.symbols(spark, sf).agg(F.count("*").alias("n")).scalar()
    return P.resolve_source(T.source_closes(spark, sf), T.source_priority(spark), n, ["date"]).select(
        text("date"), "symbol", "source", "stale", r("close").alias("close")
    )


@query(
    "live_prices",
    with_ctes(
        ["source_closes", "source_priority"],
        """, latest AS (SELECT source, symbol, arg_max(close, date) AS close, max(date) AS date FROM source_closes
            WHERE close IS NOT NULL AND close <> 0 GROUP BY 1, 2),
cov AS (SELECT source, count(*) AS n FROM latest GROUP BY 1),
pick AS (SELECT coalesce(arg_min(source, priority) FILTER (ok), arg_min(source, priority)) AS source
         FROM (SELECT cov.*, priority, n >= 0.5 * (SELECT count(DISTINCT p_brand) FROM part) AS ok
               FROM cov JOIN source_priority USING (source)))
SELECT symbol, source, CAST(date AS VARCHAR) AS date, round(close, 6) + 0.0 AS close
FROM latest WHERE source = (SELECT source FROM pick)""",
    ),
)
def live_prices(spark, sf):
    n = T.symbols(spark, sf).agg(F.count("*").alias("n")).scalar()
    return P.live_prices(T.source_closes(spark, sf), T.source_priority(spark), n).select(
        "symbol", "source", text("date"), r("close").alias("close")
    )


@query(
    "data_quality_report",
    with_ctes(
        "source_closes",
        """SELECT source, count(*) AS used, CAST(max(date) AS VARCHAR) AS last_fetch,
       CAST(date_diff('second', CAST(max(date) AS TIMESTAMP), TIMESTAMP '2001-12-31 00:00:00') AS BIGINT) AS age_seconds
FROM source_closes GROUP BY 1""",
    ),
)
def data_quality_report(spark, sf):
    return P.data_quality(T.source_closes(spark, sf), F.lit("2001-12-31 00:00:00")).select(
        "source", "used", text("last_fetch"), "age_seconds"
    )


@query(
    "equal_weight_portfolio",
    with_ctes(
        "rets", "SELECT CAST(date AS VARCHAR) AS date, round(avg(simple), 6) + 0.0 AS ret FROM rets GROUP BY date"
    ),
)
def equal_weight_portfolio(spark, sf):
    return P.equal_weight_portfolio(T.returns(spark, sf)).select(text("date"), r("ret").alias("ret"))


@query(
    "index_series",
    with_ctes(
        "closes",
        "SELECT CAST(date AS VARCHAR) AS date, round(close, 6) + 0.0 AS value FROM closes "
        f"WHERE symbol = '{T.MARKET_SYMBOL}' AND close IS NOT NULL",
    ),
)
def index_series(spark, sf):
    return P.index_series(T.closes(spark, sf), T.MARKET_SYMBOL).select(text("date"), r("value").alias("value"))


@query("vix_series", with_ctes("vix", "SELECT CAST(date AS VARCHAR) AS date, round(vix, 6) + 0.0 AS vix FROM vix"))
def vix_series(spark, sf):
    return T.vix(spark, sf).select(text("date"), r("vix").alias("vix"))


@query(
    "vix_as_of_closes",
    with_ctes(
        ["closes", "vix"],
        """SELECT CAST(d.date AS VARCHAR) AS date, round(v.vix, 6) + 0.0 AS vix
FROM (SELECT DISTINCT date FROM closes) d ASOF LEFT JOIN vix v ON d.date >= v.date""",
    ),
)
def vix_as_of_closes(spark, sf):
    days = T.closes(spark, sf).select("date").distinct()
    return P.as_of_fill(days, T.vix(spark, sf), "vix", []).select(text("date"), r("vix").alias("vix"))


@query(
    "missing_symbols",
    """SELECT DISTINCT p_brand || '/' || CAST(p_size AS VARCHAR) AS symbol FROM part WHERE p_brand || '/' || CAST(p_size AS VARCHAR) NOT IN
(SELECT p_brand || '/' || CAST(p_size AS VARCHAR) FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50)""",
)
def missing_symbols(spark, sf):
    part = T.table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("symbol")
    )
    sold = T.table(spark, sf, "lineitem").filter("l_quantity >= 50").select("l_partkey")
    return P.missing_symbols(part, part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_semi"))


@query(
    "symbol_union",
    with_ctes(
        ["refbook", "factor_dim"],
        "SELECT symbol FROM refbook UNION SELECT symbol FROM factor_dim UNION SELECT p_brand FROM part",
    ),
)
def symbol_union(spark, sf):
    return (
        T.reference_book(spark)
        .select("symbol")
        .union(T.factor_dim(spark).select("symbol"))
        .union(T.symbols(spark, sf))
        .distinct()
    )


# -- books -----------------------------------------------------------------

@query(
    "validate_books",
    """WITH raw AS (SELECT o_custkey AS book_id, p_brand AS symbol,
        sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice * (1 - l_discount) END)
          / sum(sum(l_extendedprice)) OVER (PARTITION BY o_custkey) AS weight
     FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
     GROUP BY o_custkey, p_brand, l_returnflag = 'A' AND l_linenumber = 1),
cand AS (SELECT book_id, upper(trim(symbol)) AS symbol, count(*) AS n, sum(weight) AS w, count_if(weight <= 0) AS bad
         FROM raw GROUP BY 1, 2)
SELECT book_id, CAST(sum(n) AS BIGINT) AS positions, round(sum(w), 6) + 0.0 AS total_weight,
       CASE WHEN count_if(symbol = '') > 0 THEN 'a position has an empty symbol'
            WHEN count_if(n > 1) > 0 THEN 'duplicate symbols'
            WHEN sum(bad) > 0 THEN 'a position has non-positive weight'
            WHEN abs(sum(w) - 1) > 0.05 THEN 'weights do not sum to one' END AS reason
FROM cand GROUP BY 1""",
)
def validate_books(spark, sf):
    return B.validate_books(_raw_books(spark, sf)).select(
        "book_id", "positions", r("total_weight").alias("total_weight"), "reason"
    )


def _raw_books(spark, sf):
    """Unchecked candidate books straight from the lines; many of them break a rule."""
    lines = T.table(spark, sf, "lineitem")
    spend = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per = (
        lines.join(T.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(T.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_custkey").alias("book_id"),
            F.col("p_brand").alias("symbol"),
            ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("lot"),
        )
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(spend)).alias("kept"),
            F.sum("l_extendedprice").alias("gross"),
        )
    )
    tot = per.groupBy("book_id").agg(F.sum("gross").alias("total"))
    return per.join(tot, "book_id").select("book_id", "symbol", (F.col("kept") / F.col("total")).alias("weight"))


_CAND = """, cand AS (SELECT book_id, symbol, CASE WHEN symbol = 'Brand#7' THEN weight * 1.5 ELSE weight END AS weight
         FROM books_o),
ok AS (SELECT book_id FROM cand GROUP BY 1 HAVING abs(sum(weight) - 1) <= 0.05 AND min(weight) > 0)"""


@query(
    "apply_book_updates",
    with_ctes(
        ["books_f", "books_o"],
        _CAND
        + """
SELECT book_id, symbol, round(weight, 6) + 0.0 AS weight FROM cand WHERE book_id IN (SELECT book_id FROM ok)
UNION ALL
SELECT book_id, symbol, round(weight, 6) + 0.0 FROM books_f WHERE book_id NOT IN (SELECT book_id FROM ok)""",
    ),
)
def apply_book_updates(spark, sf):
    cand = T.books_by_status(spark, sf, "O").select(
        "book_id",
        "symbol",
        F.when(F.col("symbol") == "Brand#7", F.col("weight") * 1.5).otherwise(F.col("weight")).alias("weight"),
    )
    cur = T.books_by_status(spark, sf, "F").select("book_id", "symbol", "weight")
    return B.apply_book_updates(cur, cand).select("book_id", "symbol", r("weight").alias("weight"))


@query(
    "upsert_positions",
    with_ctes(
        ["books_f", "books_o"],
        """SELECT book_id, symbol, round(weight, 6) + 0.0 AS weight, strftime(updated_at, '%Y-%m-%d') AS updated_at
FROM books_o UNION ALL
SELECT book_id, symbol, round(weight, 6) + 0.0, strftime(updated_at, '%Y-%m-%d')
FROM books_f ANTI JOIN books_o USING (book_id, symbol)""",
    ),
)
def upsert_positions(spark, sf):
    return B.upsert_positions(T.books_by_status(spark, sf, "F"), T.books_by_status(spark, sf, "O")).select(
        "book_id", "symbol", r("weight").alias("weight"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at")
    )


@query(
    "delete_positions",
    with_ctes(
        ["books", "books_p"],
        """SELECT book_id, symbol, round(weight, 6) + 0.0 AS weight FROM books
ANTI JOIN books_p USING (book_id, symbol)""",
    ),
)
def delete_positions(spark, sf):
    keys = T.books_by_status(spark, sf, "P").select("book_id", F.lower("symbol").alias("symbol"))
    return B.delete_positions(T.books(spark, sf), keys).select("book_id", "symbol", r("weight").alias("weight"))


@query(
    "positions_by_weight",
    with_ctes("books", "SELECT book_id, symbol, round(weight, 6) + 0.0 AS weight FROM books ORDER BY weight DESC"),
)
def positions_by_weight(spark, sf):
    return B.positions_by_weight(T.books(spark, sf)).select("book_id", "symbol", r("weight").alias("weight"))


@query(
    "gross_exposure",
    with_ctes("books", "SELECT book_id, round(sum(abs(weight)), 6) + 0.0 AS gross FROM books GROUP BY 1"),
)
def gross_exposure(spark, sf):
    return B.gross_exposure(T.books(spark, sf)).select("book_id", r("gross").alias("gross"))


@query(
    "same_book",
    with_ctes(
        ["books_f", "books_o"],
        """SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(a.s = b.s, false) AS "match"
FROM (SELECT book_id, string_agg(upper(symbol), ',' ORDER BY symbol) AS s FROM books_f GROUP BY 1) a
FULL JOIN (SELECT book_id, string_agg(upper(symbol), ',' ORDER BY symbol) AS s FROM books_o GROUP BY 1) b
ON a.book_id = b.book_id""",
    ),
)
def same_book(spark, sf):
    return B.same_book(T.books_by_status(spark, sf, "F"), T.books_by_status(spark, sf, "O"))


@query(
    "compare_weights",
    with_ctes(
        ["books_f", "books_o"],
        """SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(a.symbol, b.symbol) AS symbol,
       round(coalesce(a.weight, 0) * 100, 6) + 0.0 AS actual_pct, round(coalesce(b.weight, 0) * 100, 6) + 0.0 AS target_pct
FROM books_f a FULL JOIN books_o b ON a.book_id = b.book_id AND a.symbol = b.symbol""",
    ),
)
def compare_weights(spark, sf):
    return B.compare_weights(T.books_by_status(spark, sf, "F"), T.books_by_status(spark, sf, "O")).select(
        "book_id", "symbol", r("actual_pct").alias("actual_pct"), r("target_pct").alias("target_pct")
    )
