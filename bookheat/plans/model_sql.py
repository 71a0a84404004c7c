"""SQL twins of the model tables, as CTEs for the DuckDB check."""

from bookheat.plans.oracle import define
from bookheat.sources import tables as T
from bookheat import constants as C


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def value_rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


define(
    "closes",
    """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS symbol,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
define(
    "source_closes",
    """SELECT l_returnflag AS source, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS symbol,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
)
define("source_priority", f"SELECT * FROM (VALUES {value_rows(T.SOURCES)}) v(source, priority)")
define(
    "grid",
    """SELECT date, g, complete, sum(CAST(complete AS INTEGER)) OVER (ORDER BY date) - 1 AS t
FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS g,
             cnt = n AND coalesce(lag(cnt) OVER (ORDER BY date), 0) = n AS complete
      FROM (SELECT date, count(close) AS cnt, (SELECT count(DISTINCT symbol) FROM closes) AS n
            FROM closes GROUP BY date))""",
    "closes",
)
define(
    "rets",
    """SELECT t, date, symbol, close, ln(close / prev) AS ret, close / prev - 1 AS simple
FROM (SELECT g.t, c.date, c.symbol, c.close, g.complete, g.g,
             lag(c.close) OVER (PARTITION BY c.symbol ORDER BY c.date) AS prev
      FROM closes c JOIN grid g ON c.date = g.date)
WHERE complete""",
    "closes",
    "grid",
)
define("factor_dim", f"SELECT * FROM (VALUES {value_rows(zip(T.FACTOR_SYMBOLS, C.FACTORS))}) v(symbol, factor)")
define(
    "refbook",
    f"SELECT 'reference' AS book_id, symbol, 1.0 / {len(T.BOOK_SYMBOLS)} AS weight FROM (VALUES {value_rows((s,) for s in T.BOOK_SYMBOLS)}) v(symbol)",
)
define(
    "holdings",
    """SELECT o_custkey AS book_id, p_brand AS symbol, o_orderstatus AS status,
       sum(l_extendedprice * (1 - l_discount)) AS spend, sum(l_quantity) AS shares, max(o_orderdate) AS updated_at
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
)


def _books(name: str, where: str) -> None:
    define(
        name,
        f"""SELECT book_id, symbol, sum(spend) / sum(sum(spend)) OVER (PARTITION BY book_id) AS weight,
       sum(shares) AS shares, max(updated_at) AS updated_at
FROM holdings {where} GROUP BY 1, 2""",
        "holdings",
    )


_books("books", "")
for _s in "FOP":
    _books(f"books_{_s.lower()}", f"WHERE status = '{_s}'")
define(
    "vix",
    """SELECT * FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
       100 * stddev_samp(o_totalprice) / avg(o_totalprice) AS vix FROM orders GROUP BY 1) WHERE vix IS NOT NULL""",
)
define(
    "macro",
    """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS series_id,
       avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""",
)
define(
    "crises",
    'SELECT crisis, CAST(s AS DATE) AS "start", CAST(p AS DATE) AS "peak", CAST(e AS DATE) AS "end" '
    f"FROM (VALUES {value_rows(T.CRISES)}) v(crisis, s, p, e)",
)
define(
    "ticks",
    "SELECT event_type AS symbol, ts, value AS price, 1.0 AS size, event_id AS seq FROM events",
)
