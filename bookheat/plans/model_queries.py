"""Registered queries: volatility, regimes, change points and causal effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import rules as R
from bookheat.operators import causal as CA
from bookheat.operators import models as MO
from bookheat.plans.heat_sql import solve
from bookheat.plans.oracle import define, with_ctes
from bookheat.plans.registry import query
from bookheat.plans.signal_queries import features, portfolio
from bookheat.session import rounded as r
from bookheat.session import staged
from bookheat.sources import tables as T


def residuals(spark, sf):
    return staged(spark, sf, "garch", lambda: MO.garch(T.returns(spark, sf)))


def dcc(spark, sf):
    return staged(spark, sf, "dcc", lambda: MO.dcc(T.reference_book(spark), residuals(spark, sf)))


@query("garch_volatility")
def garch_volatility(spark, sf):
    return residuals(spark, sf).select("symbol", "t", r("sigma").alias("sigma"), r("alpha", 4).alias("alpha"), r("beta", 4).alias("beta"))


@query("dcc_correlation")
def dcc_correlation(spark, sf):
    return dcc(spark, sf).select("book_id", "a", "b", r("correlation").alias("correlation"), r("a_param", 4).alias("a_param"), r("b_param", 4).alias("b_param"))


@query("dcc_stress")
def dcc_stress(spark, sf):
    return dcc(spark, sf).groupBy("book_id").agg(r(R.dcc_stress(F.avg("correlation"))).alias("stress"))


@query(
    "correlation_stress",
    with_ctes(
        "avgcorr",
        "SELECT CAST(t AS BIGINT) AS t, round(least(greatest((avg_corr - 0.2) / 0.6, 0), 1), 6) + 0.0 AS stress, round(least(greatest((avg_corr + 1) / 2, 0), 1), 6) + 0.0 AS level FROM avgcorr",
    ),
)
def correlation_stress(spark, sf):
    from bookheat.plans.heat_queries import heat

    c = F.col("avg_corr")
    return heat(spark, sf).select(
        F.col("t").cast("bigint").alias("t"), r(R.dcc_stress(c)).alias("stress"), r(R.range_normalise(c)).alias("level")
    )


@query("regimes")
def regimes(spark, sf):
    g = MO.regimes(features(spark, sf))
    return g.select(
        "book_id", "regime", "regime_id", r("confidence", 4).alias("confidence"), r("transition_risk", 4).alias("transition_risk"),
        "is_fitted", F.to_json("probabilities").alias("probabilities"),
    )


@query("change_points")
def change_points(spark, sf):
    return MO.change_points(T.returns(spark, sf), ["symbol"], "t", "ret")


@query("portfolio_change_points")
def portfolio_change_points(spark, sf):
    return MO.change_points(portfolio(spark, sf).withColumn("book_id", F.lit("reference")), ["book_id"], "date", "ret")


def causal_table(spark, sf):
    return staged(
        spark, sf, "causal", lambda: CA.daily_table(T.returns(spark, sf), T.factor_dim(spark), T.reference_book(spark))
    )


# moment matrix over constant, treatment and three confounder slots; an unused slot is an identity row
define(
    "cvars",
    """SELECT t, factor AS v, ret AS x FROM rets JOIN factor_dim USING (symbol)
UNION ALL SELECT t, 'position_returns', avg(ret) FROM rets JOIN refbook USING (symbol) GROUP BY 1
UNION ALL SELECT DISTINCT t, 'const', 1.0 FROM rets""",
    "rets",
    "factor_dim",
    "refbook",
)
define("cmom", "SELECT a.v AS a, b.v AS b, sum(a.x * b.x) AS m FROM cvars a JOIN cvars b ON a.t = b.t GROUP BY 1, 2", "cvars")
_EDGES = ", ".join(f"({k}, '{s}', '{t}')" for k, (s, t) in enumerate(C.CAUSAL_EDGES))
define("cedges", f"SELECT * FROM (VALUES {_EDGES}) v(key, source, target)")
define(
    "cslots",
    """SELECT key, 0 AS i, 'const' AS v FROM cedges UNION ALL SELECT key, 1, source FROM cedges
UNION ALL SELECT key, 2, CASE WHEN 'rates' IN (source, target) THEN NULL ELSE 'rates' END FROM cedges
UNION ALL SELECT key, 3, CASE WHEN 'credit' IN (source, target) THEN NULL ELSE 'credit' END FROM cedges
UNION ALL SELECT key, 4, CASE WHEN 'market' IN (source, target) THEN NULL ELSE 'market' END FROM cedges
UNION ALL SELECT key, 5, target FROM cedges""",
    "cedges",
)
define(
    "csys",
    """SELECT r.key, r.i, c.i AS j, CASE WHEN r.v IS NULL OR c.v IS NULL THEN CASE WHEN r.i = c.i THEN 1.0 ELSE 0.0 END ELSE m.m END AS v
FROM cslots r JOIN cslots c ON r.key = c.key AND r.i < 5 LEFT JOIN cmom m ON m.a = r.v AND m.b = c.v""",
    "cslots",
    "cmom",
)
_SOLVED = solve("csolve", "csys", 5)
define("ceffects", f"SELECT e.source, e.target, s.v AS effect FROM {_SOLVED} s JOIN cedges e ON e.key = s.key AND s.i = 1 AND s.j = 5", _SOLVED, "cedges")


def causal_effects_df(spark, sf):
    return staged(spark, sf, "effects", lambda: CA.effects(causal_table(spark, sf)))


@query("causal_effects", with_ctes("ceffects", "SELECT source, target, round(effect, 5) + 0.0 AS effect FROM ceffects"))
def causal_effects(spark, sf):
    return causal_effects_df(spark, sf).select("source", "target", r("effect", 5).alias("effect"))


@query("causal_intervals")
def causal_intervals(spark, sf):
    return CA.export(CA.intervals(causal_table(spark, sf)))


@query("causal_regression_effects")
def causal_regression_effects(spark, sf):
    return CA.export(CA.regression_effects(causal_table(spark, sf)))


@query("significant_effects")
def significant_effects(spark, sf):
    sig = CA.significant(CA.regression_effects(causal_table(spark, sf)))
    return sig.filter(F.col("target") == C.PORTFOLIO_NODE).select("book_id", F.col("source").alias("factor"), r("effect").alias("effect"))


@query("discovered_dag")
def discovered_dag(spark, sf):
    return CA.export(CA.discover(causal_table(spark, sf)))


_SHOCKS = (-3.0, -1.0, 1.0, 2.0)


@query(
    "intervene",
    with_ctes(
        ["ceffects", "cvars"],
        f""", shocks AS (SELECT factor, k, k * sd AS shock FROM (SELECT v AS factor, stddev_samp(x) AS sd FROM cvars WHERE v NOT IN ('const', 'position_returns') GROUP BY 1), (VALUES {', '.join(f'({k})' for k in _SHOCKS)}) s(k)),
direct AS (SELECT source AS factor, effect FROM ceffects WHERE target = 'position_returns'),
ind AS (SELECT e.source AS factor, sum(e.effect * d.effect) AS effect FROM ceffects e JOIN direct d ON d.factor = e.target GROUP BY 1)
SELECT s.factor, CAST(k AS DOUBLE) AS k, round(shock, 5) + 0.0 AS shock, round(coalesce(d.effect, 0) * shock, 5) + 0.0 AS direct_impact, round(coalesce(i.effect, 0) * shock, 5) + 0.0 AS indirect_impact,
       round((coalesce(d.effect, 0) + coalesce(i.effect, 0)) * shock, 5) + 0.0 AS total_impact
FROM shocks s LEFT JOIN direct d ON d.factor = s.factor LEFT JOIN ind i ON i.factor = s.factor""",
    ),
)
def intervene(spark, sf):
    t = causal_table(spark, sf)
    dev = (
        t.unpivot(["book_id", "t"], list(C.FACTORS), "factor", "x")
        .groupBy("book_id", "factor")
        .agg(F.stddev_samp("x").alias("std"))
    )
    shocks = dev.select("book_id", "factor", F.explode(F.array(*[F.lit(k) for k in _SHOCKS])).alias("k"))
    out = CA.intervene(causal_effects_df(spark, sf), dev, shocks)
    return out.select(
        "factor", "k", *[r(c, 5).alias(c) for c in ("shock", "direct_impact", "indirect_impact", "total_impact")]
    )
