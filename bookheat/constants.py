"""Thresholds, weights, texts and small lookup dimensions.

Everything in this module is a plain value that results depend on; no logic.
"""

# -- heat levels -----------------------------------------------------------
LEVELS = ("cool", "warm", "hot", "critical", "emergency")
SEVERITY = {"cool": 0, "warm": 1, "hot": 2, "critical": 3, "emergency": 4}
THRESHOLDS = {"warm": 0.4636, "hot": 0.6732, "critical": 0.8029, "emergency": 0.8781}
THRESHOLD_QUANTILES = {"warm": 0.50, "hot": 0.75, "critical": 0.90, "emergency": 0.97}
HEAT_WEIGHTS = {"ar": 0.25, "turb": 0.20, "dr": 0.20, "hhi": 0.15, "corr": 0.20}
HEAT_ACTIONS = {
    "cool": "Normal trading, full position sizes",
    "warm": "Alert; reduce new position sizes by 25%",
    "hot": "Reduce overall exposure by 25%; no new correlated positions",
    "critical": "Reduce exposure by 50%; hedge factor concentrations",
    "emergency": "Halt new entries; actively reduce largest factor exposures",
}
HISTORY_ROWS = 504
WINDOW_ROWS = 60
EWMA_SPAN = 60

# -- factors ---------------------------------------------------------------
FACTORS = ("rates", "credit", "dollar", "ai_tech", "quality", "momentum", "market", "low_vol", "value")
HEDGES = {
    "market": ("SH", "Short S&P 500"),
    "ai_tech": ("SOXS", "Inverse semiconductors"),
    "rates": ("TBF", "Short 20+ Year Treasury"),
    "credit": ("SJB", "Short high-yield bonds"),
    "momentum": ("USMV", "Low volatility ETF"),
    "dollar": ("FXE", "Euro currency trust"),
    "quality": ("VTV", "Value factor (quality offset)"),
    "low_vol": ("MTUM", "Momentum factor"),
    "value": ("QUAL", "Quality factor"),
}

# -- crowding --------------------------------------------------------------
CROWDING_WEIGHTS = {
    "factor_concentration": 0.25,
    "return_dispersion": 0.15,
    "factor_comovement": 0.25,
    "correlation_level": 0.20,
    "beta_convergence": 0.15,
}
CROWDING_LEVELS = {"elevated": 0.5, "crowded": 0.7, "extreme": 0.85}

# -- sizing ----------------------------------------------------------------
REGIME_MULTIPLIERS = {"low_vol": 1.0, "normal": 0.85, "crisis": 0.5, "unknown": 0.75}
SIZING_ACTIONS = {
    "skip": "SKIP — zero or negative variance",
    "halt": "HALT — emergency heat level",
    "reduce": "REDUCE — critical heat, -50% exposure",
    "caution": "CAUTION — hot, -25% exposure, no new correlated",
    "trim": "TRIM — warm, -25% new position sizes",
    "full": "FULL — normal trading",
}

# -- causal graph ----------------------------------------------------------
PORTFOLIO_NODE = "position_returns"
CAUSAL_EDGES = (
    ("rates", "credit"),
    ("credit", "dollar"),
    ("rates", "market"),
    ("rates", "position_returns"),
    ("credit", "position_returns"),
    ("dollar", "position_returns"),
    ("market", "position_returns"),
    ("ai_tech", "position_returns"),
    ("momentum", "position_returns"),
    ("quality", "position_returns"),
    ("value", "position_returns"),
    ("low_vol", "position_returns"),
    ("market", "momentum"),
    ("market", "ai_tech"),
    ("rates", "value"),
    ("credit", "quality"),
)
CONFOUNDERS = ("rates", "credit", "market")

# -- alerts ----------------------------------------------------------------
COOLDOWN_MINUTES = {
    "daily_summary": 1440,
    "level_change": 30,
    "regime_shift": 15,
    "emergency": 360,
}
LEVEL_EMOJI = {"cool": "🟢", "warm": "🟡", "hot": "🟠", "critical": "🔴", "emergency": "⚠️"}
REGIME_EMOJI = {"low_vol": "🟢", "normal": "🟡", "crisis": "🔴"}
REGIME_IMPLICATIONS = {
    "crisis": (
        "Reduce gross exposure immediately",
        "Tighten stop losses",
        "Consider tail hedges (puts, VIX calls)",
        "Expect correlation convergence",
    ),
    "low_vol": (
        "Favorable for carry strategies",
        "Can increase position sizes cautiously",
        "Watch for complacency / vol compression",
    ),
    "other": (
        "Standard risk management applies",
        "Monitor for escalation signals",
    ),
}
EMERGENCY_FALLBACK_ACTIONS = (
    "Reduce largest positions by 50%",
    "Add tail hedges (VIX calls, SPY puts)",
    "Halt all new entries",
)
REBALANCE_REASON = "Rebalance toward HRP optimal weight ("
HOLD_NO_CHANGE = "HOLD: hold all positions (no changes recommended)"
HOLD_NO_SIGNAL = "HOLD: hold all positions (no recommendation signal)"

# -- ledgers ---------------------------------------------------------------
MARKET_ZONE = "America/New_York"
SUMMARY_TIER = "daily_summary"
WEEKLY_TIER = "weekly_scorecard"
REQUIRED_STREAK_DAYS = 7

# -- regimes ---------------------------------------------------------------
REGIMES = ("low_vol", "normal", "crisis")
DEFAULT_REGIME_PROBABILITIES = {"low_vol": 0.33, "normal": 0.34, "crisis": 0.33}
