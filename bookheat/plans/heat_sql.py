"""SQL twins of the windowed metrics and the heat score (fixed number of symbols)."""

from bookheat import constants as C
from bookheat.plans import model_sql  # noqa: F401
from bookheat.plans.oracle import define
from bookheat.sources import tables as T

N = len(T.BOOK_SYMBOLS)
K = len(T.FACTOR_SYMBOLS)


def solve(name: str, base: str, n: int) -> str:
    """CTEs that reduce (key, i, j, v) by Gauss-Jordan; columns j >= n are right-hand sides."""
    prev = base
    for p in range(n):
        cur = f"{name}_{p}"
        define(
            cur,
            f"""SELECT g.key, g.i, g.j,
       CASE WHEN g.i = {p} THEN r.v / pv.v ELSE g.v - c.v * r.v / pv.v END AS v
FROM {prev} g JOIN {prev} r ON r.key = g.key AND r.i = {p} AND r.j = g.j
JOIN {prev} c ON c.key = g.key AND c.i = g.i AND c.j = {p}
JOIN {prev} pv ON pv.key = g.key AND pv.i = {p} AND pv.j = {p}""",
            prev,
        )
        prev = cur
    return prev


def square(name: str, base: str, times: int) -> str:
    """CTEs that square the trace-normalised matrix (key, i, j, v) again and again."""
    prev = base
    for p in range(times):
        raw, cur = f"{name}_r{p}", f"{name}_{p}"
        define(
            raw,
            f"""SELECT a.key, a.i, b.j, sum(a.v * b.v) AS v FROM {prev} a JOIN {prev} b ON a.key = b.key AND a.j = b.i
GROUP BY 1, 2, 3""",
            prev,
        )
        define(
            cur,
            f"""SELECT m.key, m.i, m.j, m.v / d.tr AS v FROM {raw} m
JOIN (SELECT key, sum(v) AS tr FROM {raw} WHERE i = j GROUP BY 1) d ON d.key = m.key""",
            raw,
        )
        prev = cur
    return prev


define("days", "SELECT DISTINCT t, date FROM rets", "rets")
define(
    "win",
    """SELECT b.t, b.date, a.symbol, b.t - 1 - a.t AS k, a.simple AS x
FROM days b JOIN rets a ON a.t BETWEEN b.t - 60 AND b.t - 1 WHERE b.t >= 60""",
    "rets",
    "days",
)
define("pwin", "SELECT w.*, weight FROM win w JOIN refbook USING (symbol)", "win", "refbook")
define(
    "ewc",
    """SELECT p.t, p.symbol, p.k, sqrt(pow(59.0 / 61, p.k) / m.sw) * (p.x - m.mu) AS c
FROM pwin p JOIN (SELECT t, symbol, sum(pow(59.0 / 61, k)) AS sw, sum(pow(59.0 / 61, k) * x) / sum(pow(59.0 / 61, k)) AS mu
                  FROM pwin GROUP BY 1, 2) m ON m.t = p.t AND m.symbol = p.symbol""",
    "pwin",
)
define(
    "ewpairs",
    """SELECT a.t, a.symbol AS a, b.symbol AS b, sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS corr
FROM ewc a JOIN ewc b ON a.t = b.t AND a.k = b.k AND a.symbol < b.symbol GROUP BY 1, 2, 3""",
    "ewc",
)
define("avgcorr", "SELECT t, avg(corr) AS avg_corr FROM ewpairs GROUP BY 1", "ewpairs")
define(
    "toppair",
    """SELECT t, arg_max(a || '-' || b, abs(corr)) AS top_pair, arg_max(corr, abs(corr)) AS top_corr
FROM ewpairs GROUP BY 1""",
    "ewpairs",
)
define(
    "pidx",
    "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i, weight FROM refbook",
    "refbook",
)
define(
    "scov",
    """SELECT a.t AS key, pa.i, pb.i AS j, covar_samp(a.x, b.x) AS v
FROM pwin a JOIN pwin b ON a.t = b.t AND a.k = b.k JOIN pidx pa ON pa.symbol = a.symbol
JOIN pidx pb ON pb.symbol = b.symbol GROUP BY 1, 2, 3""",
    "pwin",
    "pidx",
)
define(
    "divratio",
    """SELECT v.t, greatest(vols / sqrt(greatest(var, 1e-12)), 1.0) AS div_ratio
FROM (SELECT t, sum(weight * sd) AS vols FROM (SELECT t, symbol, weight, stddev_samp(x) AS sd FROM pwin GROUP BY 1, 2, 3) GROUP BY 1) v
JOIN (SELECT key AS t, sum(a.weight * b.weight * v) AS var FROM scov JOIN pidx a ON a.i = scov.i JOIN pidx b ON b.i = scov.j
      GROUP BY 1) q ON q.t = v.t""",
    "pwin",
    "scov",
    "pidx",
)
define(
    "scov_n",
    """SELECT s.key, s.i, s.j, s.v / d.tr AS v FROM scov s
JOIN (SELECT key, sum(v) AS tr FROM scov WHERE i = j GROUP BY 1) d ON d.key = s.key""",
    "scov",
)
_POWER = square("pow", "scov_n", 16)
define(
    "absorb",
    f"""SELECT key AS t, least(top / (total * 59.0 / 60), 1.0) AS absorption_ratio
FROM (SELECT p.key, sum(p.v * s.v) / sum(CASE WHEN p.i = p.j THEN p.v ELSE 0 END) AS top
      FROM {_POWER} p JOIN scov s ON s.key = p.key AND s.i = p.j AND s.j = p.i GROUP BY 1)
JOIN (SELECT key, sum(v) AS total FROM scov WHERE i = j GROUP BY 1) USING (key)""",
    _POWER,
    "scov",
)
define("hist", "SELECT * FROM pwin WHERE k >= 1", "pwin")
define(
    "turb_d",
    """SELECT p.t, pidx.i, p.x - h.mu AS d FROM pwin p JOIN pidx USING (symbol)
JOIN (SELECT t, symbol, avg(x) AS mu FROM hist GROUP BY 1, 2) h ON h.t = p.t AND h.symbol = p.symbol WHERE p.k = 0""",
    "pwin",
    "hist",
    "pidx",
)
define(
    "turb_m",
    f"""SELECT a.t AS key, pa.i, pb.i AS j, covar_samp(a.x, b.x) + CASE WHEN pa.i = pb.i THEN 1e-8 ELSE 0 END AS v
FROM hist a JOIN hist b ON a.t = b.t AND a.k = b.k JOIN pidx pa ON pa.symbol = a.symbol
JOIN pidx pb ON pb.symbol = b.symbol GROUP BY 1, 2, 3
UNION ALL SELECT t, i, {N}, d FROM turb_d""",
    "hist",
    "pidx",
    "turb_d",
)
_TURB = solve("turb_s", "turb_m", N)
define(
    "turb",
    f"""SELECT d.t, greatest(sum(d.d * s.v), 0) AS turbulence FROM turb_d d
JOIN {_TURB} s ON s.key = d.t AND s.i = d.i AND s.j = {N} GROUP BY 1""",
    "turb_d",
    _TURB,
)
define("fidx", "SELECT symbol, factor, row_number() OVER (ORDER BY factor) AS i FROM factor_dim", "factor_dim")
define(
    "fx",
    """SELECT t, k, i, x AS v FROM win JOIN fidx USING (symbol)
UNION ALL SELECT DISTINCT t, k, 0, 1.0 FROM win""",
    "win",
    "fidx",
)
define(
    "beta_m",
    f"""SELECT a.t AS key, a.i, b.i AS j, sum(a.v * b.v) AS v FROM fx a JOIN fx b ON a.t = b.t AND a.k = b.k GROUP BY 1, 2, 3
UNION ALL
SELECT p.t, f.i, {K + 1} + pidx.i, sum(p.x * f.v) FROM pwin p JOIN fx f ON f.t = p.t AND f.k = p.k
JOIN pidx USING (symbol) GROUP BY 1, 2, 3""",
    "fx",
    "pwin",
    "pidx",
)
_BETA = solve("beta_s", "beta_m", K + 1)
define(
    "betas",
    f"""SELECT s.key AS t, pidx.symbol, fidx.factor, s.v AS beta FROM {_BETA} s
JOIN pidx ON s.j = {K + 1} + pidx.i JOIN fidx ON fidx.i = s.i""",
    _BETA,
    "pidx",
    "fidx",
)
define(
    "exposures",
    """SELECT t, factor, sum(weight * beta) AS total_exposure,
       abs(sum(weight * beta)) / sum(abs(sum(weight * beta))) OVER (PARTITION BY t) AS exposure_share
FROM betas JOIN refbook USING (symbol) GROUP BY 1, 2""",
    "betas",
    "refbook",
)
define(
    "hhi",
    """SELECT t, sum(exposure_share * exposure_share) AS factor_hhi,
       arg_max(factor, abs(total_exposure)) AS dominant_factor FROM exposures GROUP BY 1""",
    "exposures",
)
define(
    "parts",
    """SELECT 'reference' AS book_id, t, date, absorption_ratio, turbulence, div_ratio, factor_hhi, avg_corr,
       dominant_factor, top_pair, top_corr, 1 / greatest(div_ratio, 0.01) AS inv_dr
FROM days JOIN absorb USING (t) JOIN turb USING (t) JOIN divratio USING (t) JOIN hhi USING (t)
JOIN avgcorr USING (t) JOIN toppair USING (t)""",
    "days",
    "absorb",
    "turb",
    "divratio",
    "hhi",
    "avgcorr",
    "toppair",
)
_W = C.HEAT_WEIGHTS
_T = C.THRESHOLDS


def level_case(score: str) -> str:
    return (
        f"CASE WHEN {score} >= {_T['emergency']} THEN 'emergency' WHEN {score} >= {_T['critical']} THEN 'critical' "
        f"WHEN {score} >= {_T['hot']} THEN 'hot' WHEN {score} >= {_T['warm']} THEN 'warm' ELSE 'cool' END"
    )


def action_case(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in C.HEAT_ACTIONS.items()) + " END"


define(
    "heat",
    f"""SELECT *, {level_case('score')} AS level FROM (
SELECT *, least(greatest({_W['ar']} * ar_pct + {_W['turb']} * turbulence_pct + {_W['dr']} * div_ratio_pct
     + {_W['hhi']} * factor_hhi_pct + {_W['corr']} * avg_corr_pct, 0), 1) AS score
FROM (SELECT p.*, r.ar_pct, r.turbulence_pct, r.div_ratio_pct, r.factor_hhi_pct, r.avg_corr_pct
      FROM parts p JOIN (
  SELECT a.t, avg(CAST(b.absorption_ratio <= a.absorption_ratio AS INTEGER)) AS ar_pct,
         avg(CAST(b.turbulence <= a.turbulence AS INTEGER)) AS turbulence_pct,
         avg(CAST(b.inv_dr <= a.inv_dr AS INTEGER)) AS div_ratio_pct,
         avg(CAST(b.factor_hhi <= a.factor_hhi AS INTEGER)) AS factor_hhi_pct,
         avg(CAST(b.avg_corr <= a.avg_corr AS INTEGER)) AS avg_corr_pct
  FROM parts a JOIN parts b ON b.t BETWEEN a.t - 503 AND a.t GROUP BY 1) r ON r.t = p.t))""",
    "parts",
)
