"""Registered queries: moments, metrics, factors and the heat score."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.operators import factors as X
from bookheat.operators import heat as H
from bookheat.operators import metrics as M
from bookheat.operators import moments as MM
from bookheat.operators import panel as P
from bookheat.plans import heat_sql
from bookheat.plans.oracle import define, with_ctes
from bookheat.plans.panel_queries import text
from bookheat.plans.registry import query
from bookheat.session import rounded as r
from bookheat.session import spread, staged
from bookheat.sources import tables as T


def big(col: str):
    return F.col(col).cast("bigint").alias(col)


def replay_windows(spark, sf):
    """Windows of 60 simple returns ending the day before their label, staged."""
    return staged(
        spark,
        sf,
        "replay-windows",
        lambda: spread(P.windows(T.returns(spark, sf), "simple", C.WINDOW_ROWS, include_current=False), "t", "symbol"),
    )


def exposures(spark, sf):
    """Rolling factor betas of every non-factor symbol, staged."""
    return staged(
        spark, sf, "exposures", lambda: X.rolling_exposures(T.returns(spark, sf), T.factor_dim(spark), "simple", C.WINDOW_ROWS)
    )


def heat(spark, sf):
    """Rolling heat of the reference book, staged."""

    def build():
        raw = M.window_metrics(M.members(T.reference_book(spark), replay_windows(spark, sf)))
        hhi = X.factor_hhi(X.aggregate_exposures(exposures(spark, sf), T.reference_book(spark)))
        return H.blend(H.join_components(raw, hhi))

    return staged(spark, sf, "heat", build)


def book_heat(spark, sf, asked=None, named=True):
    """Heat of every customer book on every row day, ranked in its own history.

    With ``asked`` (book_id, date, or the list of dates that follows from the packed row of a book) only the newest day and those in force on the dates asked for. Without ``named`` no dominant factor and top pair.
    """
    return H.own_history(T.packed_books(spark, sf), T.returns(spark, sf), T.factor_dim(spark), asked=asked, named=named)


def book_component_lists(spark, sf):
    """The last values of every component of every customer book, as lists on one row."""
    return H.own_component_lists(T.packed_books(spark, sf), T.returns(spark, sf), T.factor_dim(spark))


@query("heat_books")
def heat_books(spark, sf):
    digits = {"absorption_ratio": 6, "turbulence": 4, "div_ratio": 6, "factor_hhi": 6, "avg_corr": 6, "score": 10}
    return H.reported_history(T.packed_books(spark, sf), T.returns(spark, sf), T.factor_dim(spark), digits)


def latest_windows(spark, sf, rows: int):
    """Newest ``rows`` log returns per symbol as one labelled window (t, date, symbol, x), staged."""

    def build():
        returns = T.returns(spark, sf)
        newest = returns.agg(F.max("t")).scalar()
        return P.windows(returns.filter(F.col("t") > newest - rows), "ret", rows, include_current=True)

    return staged(spark, sf, f"latest-{rows}", build)


def latest_exposures(spark, sf):
    return staged(
        spark,
        sf,
        "latest-exposures",
        lambda: X.factor_exposures(latest_windows(spark, sf, C.WINDOW_ROWS), T.factor_dim(spark)),
    )


# -- latest-window SQL building blocks ---------------------------------------
define(
    "lwin",
    """SELECT symbol, (SELECT max(t) FROM rets) - t AS k, ret AS x FROM rets
WHERE t > (SELECT max(t) FROM rets) - 252""",
    "rets",
)
define("lwin60", "SELECT * FROM lwin WHERE k < 60", "lwin")
define(
    "lew",
    """SELECT l.symbol, l.k, m.sw, m.sq, sqrt(pow(59.0 / 61, l.k)) * (l.x - m.mu) AS c
FROM lwin l JOIN (SELECT symbol, sum(pow(59.0 / 61, k)) AS sw, sum(pow(59.0 / 61, 2 * k)) AS sq,
                         sum(pow(59.0 / 61, k) * x) / sum(pow(59.0 / 61, k)) AS mu
                  FROM lwin GROUP BY 1) m ON m.symbol = l.symbol""",
    "lwin",
)
define(
    "lpairs",
    """SELECT a.symbol AS a, b.symbol AS b, sum(a.c * b.c) * max(a.sw) / (max(a.sw) * max(a.sw) - max(a.sq)) AS cov,
       sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS corr
FROM lew a JOIN lew b ON a.k = b.k AND a.symbol < b.symbol GROUP BY 1, 2""",
    "lew",
)


@query(
    "ewma_corr_latest",
    with_ctes("lpairs", "SELECT a, b, round(cov, 6) + 0.0 AS cov, round(corr, 6) + 0.0 AS corr FROM lpairs"),
)
def ewma_corr_latest(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252))
    return MM.pair_values(v, [], ["c", "z"]).select("a", "b", r("c").alias("cov"), r("z").alias("corr"))


@query(
    "avg_corr_latest",
    with_ctes("lpairs", "SELECT 25 AS n, round(avg(corr), 6) + 0.0 AS avg_corr FROM lpairs"),
)
def avg_corr_latest(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252)).withColumn("panel", F.lit("all"))
    return MM.avg_pairwise(v, ["panel"]).select(F.col("n").cast("int").alias("n"), r("avg_corr").alias("avg_corr"))


@query(
    "top_pair",
    with_ctes(
        "lpairs",
        """SELECT arg_max(a, abs(corr)) AS a, arg_max(b, abs(corr)) AS b, round(arg_max(corr, abs(corr)), 6) + 0.0 AS corr
FROM lpairs""",
    ),
)
def top_pair(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252)).withColumn("panel", F.lit("all"))
    return MM.pair_values(v, ["panel"], ["z"], keep="top").select("a", "b", r("z").alias("corr"))


@query(
    "correlation_edges",
    with_ctes(
        "lpairs",
        """SELECT a AS src, b AS dst, round(abs(corr), 6) + 0.0 AS weight FROM lpairs WHERE abs(corr) >= 0.2""",
    ),
)
def correlation_edges(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252))
    return MM.pair_values(v, [], ["z"], keep="edges", threshold=0.2).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), r(F.abs("z")).alias("weight")
    )


@query(
    "sample_corr",
    with_ctes(
        "lwin60",
        """SELECT a.symbol AS a, b.symbol AS b, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov, round(corr(a.x, b.x), 6) + 0.0 AS corr
FROM lwin60 a JOIN lwin60 b ON a.k = b.k AND a.symbol < b.symbol GROUP BY 1, 2""",
    ),
)
def sample_corr(spark, sf):
    v = MM.sample_vectors(MM.series(T.returns(spark, sf), "ret", 60))
    return MM.pair_values(v, [], ["c", "z"]).select("a", "b", r("c").alias("cov"), r("z").alias("corr"))


@query(
    "correlation_matrix_wide",
    with_ctes(
        "lpairs",
        ", sym AS (SELECT a, b, corr FROM lpairs UNION ALL SELECT b, a, corr FROM lpairs UNION ALL "
        "SELECT DISTINCT symbol, symbol, 1.0 FROM lwin) SELECT a, "
        + ", ".join(
            f"round(max(corr) FILTER (b = '{s}'), 3) + 0.0 AS \"{s}\"" for s in T.ALL_SYMBOLS
        )
        + " FROM sym GROUP BY a",
    ),
)
def correlation_matrix_wide(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252))
    pairs = MM.pair_values(v, [], ["z"])
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "z")).unionByName(
        v.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.lit(1.0).alias("z"))
    )
    return both.groupBy("a").pivot("b", list(T.ALL_SYMBOLS)).agg(r(F.first("z"), 3))


@query(
    "ewma_std",
    with_ctes(
        "win",
        """SELECT CAST(w.t AS BIGINT) AS t, w.symbol,
       round(sqrt(sum(pow(59.0 / 61, k) * (x - mu) * (x - mu)) * max(sw) / (max(sw) * max(sw) - max(sq))), 6) + 0.0 AS ewma_std
FROM win w JOIN (SELECT t, symbol, sum(pow(59.0 / 61, k)) AS sw, sum(pow(59.0 / 61, 2 * k)) AS sq,
                        sum(pow(59.0 / 61, k) * x) / sum(pow(59.0 / 61, k)) AS mu FROM win GROUP BY 1, 2) m
  ON m.t = w.t AND m.symbol = w.symbol GROUP BY 1, 2""",
    ),
)
def ewma_std(spark, sf):
    from bookheat.functions import arrays as A

    c = A.with_ewma_centered(replay_windows(spark, sf), "x", "c", C.EWMA_SPAN, debias=True)
    return c.select(big("t"), "symbol", r(F.sqrt(A.dot(F.col("c"), F.col("c")))).alias("ewma_std"))


@query(
    "market_beta",
    with_ctes(
        "lwin60",
        f"""SELECT a.symbol, round(regr_slope(a.x, m.x), 6) + 0.0 AS beta FROM lwin60 a
JOIN lwin60 m ON m.k = a.k AND m.symbol = '{T.MARKET_SYMBOL}' GROUP BY 1""",
    ),
)
def market_beta(spark, sf):
    w = latest_windows(spark, sf, 60)
    return MM.market_beta(w, T.MARKET_SYMBOL, ["t"]).select("symbol", r("beta").alias("beta"))


@query(
    "cross_sectional_std",
    with_ctes(
        "rets",
        """SELECT CAST(date AS VARCHAR) AS date, round(cs, 6) + 0.0 AS cs_std,
       round(avg(cs) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) + 0.0 AS dispersion
FROM (SELECT date, stddev_samp(ret) AS cs FROM rets GROUP BY 1)""",
    ),
)
def cross_sectional_std(spark, sf):
    d = MM.cross_sectional_std(T.returns(spark, sf).withColumn("panel", F.lit("all")), ["panel"], "ret", 60)
    return d.select(text("date"), r("cs_std").alias("cs_std"), r("dispersion").alias("dispersion"))


@query(
    "avg_corr_rolling",
    with_ctes("avgcorr", "SELECT CAST(t AS BIGINT) AS t, round(avg_corr, 6) + 0.0 AS avg_corr FROM avgcorr"),
)
def avg_corr_rolling(spark, sf):
    return M.average_correlation(T.reference_book(spark), replay_windows(spark, sf)).select(
        big("t"), r("avg_corr").alias("avg_corr")
    )


@query(
    "diversification_ratio_rolling",
    with_ctes("divratio", "SELECT CAST(t AS BIGINT) AS t, round(div_ratio, 6) + 0.0 AS div_ratio FROM divratio"),
)
def diversification_ratio_rolling(spark, sf):
    return M.diversification_ratio(T.reference_book(spark), replay_windows(spark, sf)).select(
        big("t"), r("div_ratio").alias("div_ratio")
    )


@query(
    "diversification_ratio_books",
    with_ctes(
        ["books", "lwin60"],
        """, cov AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.x, b.x) AS cov FROM lwin60 a JOIN lwin60 b ON a.k = b.k
           GROUP BY 1, 2)
SELECT v.book_id, round(CASE WHEN n < 2 THEN 1 ELSE greatest(vols / sqrt(greatest(var, 1e-12)), 1) END, 6) + 0.0 AS div_ratio
FROM (SELECT book_id, count(*) AS n, sum(weight * sqrt(cov)) AS vols FROM books JOIN cov ON a = symbol AND b = symbol GROUP BY 1) v
JOIN (SELECT x.book_id, sum(x.weight * y.weight * cov) AS var FROM books x JOIN books y ON x.book_id = y.book_id
      JOIN cov ON a = x.symbol AND b = y.symbol GROUP BY 1) q ON q.book_id = v.book_id""",
    ),
)
def diversification_ratio_books(spark, sf):
    return M.diversification_ratio(T.books(spark, sf), latest_windows(spark, sf, 60), rolling=False).select("book_id", r("div_ratio").alias("div_ratio"))


@query(
    "avg_corr_books",
    with_ctes(
        ["books", "lwin60"],
        """, w AS (SELECT symbol, k, x, pow(59.0 / 61, k) AS w FROM lwin60),
c AS (SELECT w.symbol, w.k, sqrt(w.w) * (w.x - m.mu) AS c FROM w
      JOIN (SELECT symbol, sum(w * x) / sum(w) AS mu FROM w GROUP BY 1) m ON m.symbol = w.symbol),
p AS (SELECT a.symbol AS a, b.symbol AS b, sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS corr
      FROM c a JOIN c b ON a.k = b.k AND a.symbol < b.symbol GROUP BY 1, 2)
SELECT n.book_id, n.n, round(coalesce(q.c, 0), 6) + 0.0 AS avg_corr
FROM (SELECT book_id, count(*) AS n FROM books GROUP BY 1) n
LEFT JOIN (SELECT x.book_id, avg(corr) AS c FROM books x JOIN books y ON x.book_id = y.book_id
           JOIN p ON a = x.symbol AND b = y.symbol GROUP BY 1) q ON q.book_id = n.book_id""",
    ),
)
def avg_corr_books(spark, sf):
    a = M.average_correlation(T.books(spark, sf), latest_windows(spark, sf, 60), rolling=False)
    return a.select("book_id", "n", r("avg_corr").alias("avg_corr"))


def _window_metrics(spark, sf):
    return staged(
        spark,
        sf,
        "window-metrics",
        lambda: M.window_metrics(M.members(T.reference_book(spark), replay_windows(spark, sf))),
    )


@query(
    "absorption_ratio_rolling",
    with_ctes("absorb", "SELECT CAST(t AS BIGINT) AS t, round(absorption_ratio, 5) + 0.0 AS absorption_ratio FROM absorb"),
)
def absorption_ratio_rolling(spark, sf):
    return _window_metrics(spark, sf).select(big("t"), r("absorption_ratio", 5).alias("absorption_ratio"))


@query(
    "turbulence_rolling",
    with_ctes("turb", "SELECT CAST(t AS BIGINT) AS t, round(turbulence, 4) + 0.0 AS turbulence FROM turb"),
)
def turbulence_rolling(spark, sf):
    return _window_metrics(spark, sf).select(big("t"), r("turbulence", 4).alias("turbulence"))


@query(
    "top_pair_rolling",
    with_ctes("toppair", "SELECT CAST(t AS BIGINT) AS t, top_pair, round(top_corr, 6) + 0.0 AS top_corr FROM toppair"),
)
def top_pair_rolling(spark, sf):
    return _window_metrics(spark, sf).select(
        big("t"), F.concat_ws("-", "pair_a", "pair_b").alias("top_pair"), r("top_corr").alias("top_corr")
    )


@query(
    "factor_exposures_rolling",
    with_ctes("betas", "SELECT CAST(t AS BIGINT) AS t, symbol, factor, round(beta, 5) + 0.0 AS beta FROM betas"),
)
def factor_exposures_rolling(spark, sf):
    return (
        exposures(spark, sf)
        .join(T.reference_book(spark), "symbol", "left_semi")
        .select(big("t"), "symbol", "factor", r("beta", 5).alias("beta"))
    )


# betas, t statistics and R² of the newest window for every non-factor symbol
define("lsym", "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i FROM (SELECT DISTINCT symbol FROM lwin60 ANTI JOIN factor_dim USING (symbol))", "lwin60", "factor_dim")
define(
    "lfx",
    """SELECT k, i, x AS v FROM lwin60 JOIN fidx USING (symbol) UNION ALL SELECT DISTINCT k, 0, 1.0 FROM lwin60""",
    "lwin60",
    "fidx",
)
define(
    "lbeta_m",
    """SELECT 0 AS key, a.i, b.i AS j, sum(a.v * b.v) AS v FROM lfx a JOIN lfx b ON a.k = b.k GROUP BY 1, 2, 3
UNION ALL SELECT 0, a.i, 10 + b.i, CAST(a.i = b.i AS INTEGER) FROM (SELECT DISTINCT i FROM lfx) a, (SELECT DISTINCT i FROM lfx) b
UNION ALL SELECT 0, f.i, 20 + s.i, sum(w.x * f.v) FROM lwin60 w JOIN lsym s USING (symbol) JOIN lfx f ON f.k = w.k GROUP BY 1, 2, 3""",
    "lfx",
    "lsym",
    "lwin60",
)
_LB = heat_sql.solve("lbeta_s", "lbeta_m", 10)
define(
    "lbetas",
    f"""SELECT s.symbol, fidx.factor, b.v AS beta, b.v / sqrt(iv.v * e.sse / 50) AS t_stat, 1 - e.sse / e.sst AS r_squared
FROM {_LB} b JOIN lsym s ON b.j = 20 + s.i JOIN fidx ON fidx.i = b.i JOIN {_LB} iv ON iv.i = b.i AND iv.j = 10 + b.i
JOIN (SELECT symbol, sum((x - fit) * (x - fit)) AS sse, var_pop(x) * count(*) AS sst
      FROM (SELECT w.symbol, w.k, w.x, sum(b.v * f.v) AS fit FROM lwin60 w JOIN lsym s USING (symbol)
            JOIN {_LB} b ON b.j = 20 + s.i JOIN lfx f ON f.k = w.k AND f.i = b.i GROUP BY 1, 2, 3) GROUP BY 1) e ON e.symbol = s.symbol""",
    _LB,
    "lsym",
    "fidx",
    "lfx",
    "lwin60",
)


@query(
    "factor_exposures_latest",
    with_ctes(
        "lbetas",
        """SELECT symbol, factor, round(beta, 5) + 0.0 AS beta, round(t_stat, 5) + 0.0 AS t_stat,
       round(r_squared, 5) + 0.0 AS r_squared FROM lbetas""",
    ),
)
def factor_exposures_latest(spark, sf):
    return latest_exposures(spark, sf).select(
        "symbol", "factor", r("beta", 5).alias("beta"), r("t_stat", 5).alias("t_stat"), r("r_squared", 5).alias("r_squared")
    )


define(
    "lexposures",
    """SELECT book_id, factor, sum(weight * beta) AS total_exposure,
       abs(sum(weight * beta)) / sum(abs(sum(weight * beta))) OVER (PARTITION BY book_id) AS exposure_share
FROM books JOIN lbetas USING (symbol) GROUP BY 1, 2""",
    "books",
    "lbetas",
)


@query(
    "aggregate_exposures_books",
    with_ctes(
        "lexposures",
        """SELECT book_id, factor, round(total_exposure, 6) + 0.0 AS total_exposure, round(exposure_share, 6) + 0.0 AS exposure_share
FROM lexposures""",
    ),
)
def aggregate_exposures_books(spark, sf):
    return X.aggregate_exposures(latest_exposures(spark, sf), T.books(spark, sf)).select(
        "book_id", "factor", r("total_exposure").alias("total_exposure"), r("exposure_share").alias("exposure_share")
    )


@query(
    "factor_hhi_books",
    with_ctes(
        "lexposures",
        """SELECT book_id, round(sum(exposure_share * exposure_share), 6) + 0.0 AS factor_hhi,
       arg_max(factor, abs(total_exposure)) AS dominant_factor FROM lexposures GROUP BY 1""",
    ),
)
def factor_hhi_books(spark, sf):
    return X.factor_hhi(X.aggregate_exposures(latest_exposures(spark, sf), T.books(spark, sf))).select(
        "book_id", r("factor_hhi").alias("factor_hhi"), "dominant_factor"
    )


@query(
    "heat_components_books",
)
def heat_components_books(spark, sf):
    raw = M.window_metrics(M.members(T.books(spark, sf), latest_windows(spark, sf, C.WINDOW_ROWS), rolling=False))
    hhi = X.factor_hhi(X.aggregate_exposures(latest_exposures(spark, sf), T.books(spark, sf)))
    return H.join_components(raw, hhi).select(
        "book_id", text("date"), *[r(c).alias(c) for c in ("absorption_ratio", "turbulence", "div_ratio", "factor_hhi", "avg_corr")],
        "dominant_factor", "top_pair",
    )


@query(
    "rolling_heat",
    with_ctes(
        "heat",
        f"""SELECT book_id, CAST(date AS VARCHAR) AS date, round(score, 10) + 0.0 AS score, level,
       round(absorption_ratio, 5) + 0.0 AS absorption_ratio, round(turbulence, 4) + 0.0 AS turbulence,
       round(turbulence_pct, 6) + 0.0 AS turbulence_pct, round(div_ratio, 6) + 0.0 AS div_ratio,
       round(div_ratio_pct, 6) + 0.0 AS div_ratio_pct, round(factor_hhi, 6) + 0.0 AS factor_hhi,
       round(factor_hhi_pct, 6) + 0.0 AS factor_hhi_pct, round(avg_corr, 6) + 0.0 AS avg_corr,
       round(avg_corr_pct, 6) + 0.0 AS avg_corr_pct, round(ar_pct, 6) + 0.0 AS ar_pct, dominant_factor, top_pair,
       {heat_sql.action_case('level')} AS action FROM heat""",
    ),
)
def rolling_heat(spark, sf):
    h = heat(spark, sf)
    digits = {"absorption_ratio": 5, "turbulence": 4, "score": 10}
    nums = (
        "score absorption_ratio turbulence turbulence_pct div_ratio div_ratio_pct factor_hhi factor_hhi_pct "
        "avg_corr avg_corr_pct ar_pct"
    ).split()
    return h.select(
        "book_id", text("date"), *[r(c, digits.get(c, 6)).alias(c) for c in nums],
        "level", "dominant_factor", "top_pair", "action",
    )


@query(
    "pct_rank_504",
    with_ctes(
        "rets",
        """SELECT CAST(a.t AS BIGINT) AS t, a.symbol, round(avg(CAST(b.ret <= a.ret AS INTEGER)), 6) + 0.0 AS pct
FROM rets a JOIN rets b ON a.symbol = b.symbol AND b.t BETWEEN a.t - 503 AND a.t GROUP BY 1, 2""",
    ),
)
def pct_rank_504(spark, sf):
    return T.returns(spark, sf).select(big("t"), "symbol", r(M.pct_rank_incl("ret", ["symbol"], "t")).alias("pct"))


@query(
    "pct_rank_previous",
    with_ctes(
        "rets",
        """SELECT CAST(a.t AS BIGINT) AS t, a.symbol,
       round(CASE WHEN a.t + 1 > 10 THEN avg(CAST(b.ret <= a.ret AS INTEGER)) ELSE 0.5 END, 6) + 0.0 AS pct,
       round(CASE WHEN a.t + 1 > 5 THEN avg(CAST(b.ret >= a.ret AS INTEGER)) ELSE 0.5 END, 6) + 0.0 AS inv_pct
FROM rets a LEFT JOIN rets b ON a.symbol = b.symbol AND b.t BETWEEN a.t - 503 AND a.t - 1 GROUP BY a.t, a.symbol""",
    ),
)
def pct_rank_previous(spark, sf):
    return T.returns(spark, sf).select(
        big("t"),
        "symbol",
        r(M.pct_rank_excl("ret", ["symbol"], "t")).alias("pct"),
        r(M.inv_pct_rank_excl("ret", ["symbol"], "t")).alias("inv_pct"),
    )


@query(
    "append_once_per_date",
    """SELECT CAST(user_id AS BIGINT) AS book_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, value AS score
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def append_once_per_date(spark, sf):
    ev = T.table(spark, sf, "events").select(
        F.col("user_id").alias("book_id"), F.to_date("ts").alias("date"), F.col("value").alias("score"),
        F.struct("ts", "event_id").alias("arrival"),
    )
    return H.once_per_date(ev, "arrival").select("book_id", text("date"), "score")
