"""Scalar rules: levels, sizing, limits, verdicts, texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookheat import constants as C


def ladder(value: Column, steps: dict[str, float], below: str) -> Column:
    """Name of the highest step that ``value`` reaches."""
    ordered = sorted(steps.items(), key=lambda s: -s[1])
    first, *rest = ordered
    chain = F.when(value >= first[1], first[0])
    for name, cut in rest:
        chain = chain.when(value >= cut, name)
    return chain.otherwise(below)


def lookup(key: Column, values: dict, default=None) -> Column:
    chain = reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), values.items(), F)
    return chain.otherwise(default)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def classify_heat(score: Column, thresholds: dict[str, float] | None = None) -> Column:
    return ladder(score, thresholds or C.THRESHOLDS, "cool")


def heat_action(level: Column) -> Column:
    return lookup(level, C.HEAT_ACTIONS, "")


def crowding_level(x: Column) -> Column:
    return ladder(x, C.CROWDING_LEVELS, "normal")


def crowding_alpha(pct: Column) -> Column:
    a = (
        F.when(pct > 0.9, -2.0 * (pct - 0.5))
        .when(pct > 0.7, -(pct - 0.5))
        .when(pct < 0.3, 0.5 * (0.5 - pct))
        .otherwise(0.0)
    )
    return clip(a, -1.0, 1.0)


def range_normalise(c: Column) -> Column:
    return clip((c + 1) / 2, 0.0, 1.0)


def dcc_stress(avg: Column) -> Column:
    return F.coalesce(clip((avg - 0.2) / 0.6, 0.0, 1.0), F.lit(0.5))


def mantegna_distance(c: Column) -> Column:
    return F.sqrt(F.greatest(2.0 * (1 - c), F.lit(0.0)))


def regime_multiplier(regime: Column) -> Column:
    return lookup(regime, C.REGIME_MULTIPLIERS, 0.75)


def kelly(mu: Column, var: Column, heat: Column, regime: Column, fraction=0.5, floor=0.4, ceiling=0.85) -> dict[str, Column]:
    """Heat-adjusted sizing: raw and adjusted fraction, multiplier and action text."""
    skip = var <= 0
    raw = F.try_divide(mu, var) * fraction
    heat_mult = F.when(heat < floor, 1.0).when(heat >= ceiling, 0.0).otherwise(1 - (heat - floor) / (ceiling - floor))
    mult = heat_mult * regime_multiplier(regime)
    a = C.SIZING_ACTIONS
    action = (
        F.when(skip, a["skip"])
        .when(heat >= ceiling, a["halt"])
        .when(heat >= 0.7, a["reduce"])
        .when(heat >= 0.6, a["caution"])
        .when(heat >= 0.4, a["trim"])
        .otherwise(a["full"])
    )
    zero = F.lit(0.0)
    return {
        "kelly_raw": F.when(skip, zero).otherwise(raw),
        "kelly_adjusted": F.when(skip, zero).otherwise(raw * mult),
        "multiplier": F.when(skip, zero).otherwise(mult),
        "action": action,
    }


def exposure_limits(heat: Column, exposure: Column, regime: Column) -> dict[str, Column]:
    """Maximum exposure, target reduction and whether new positions are allowed."""
    crisis = regime == "crisis"
    keep = F.when(heat >= 0.7, 0.5).when(heat >= 0.4, 0.75).otherwise(1.0)
    cut = F.when(heat >= 0.7, 0.5).when(heat >= 0.4, 0.25).otherwise(0.0)
    return {
        "max_exposure": exposure * keep * F.when(crisis, 0.75).otherwise(1.0),
        "target_reduction": F.when(crisis, F.greatest(cut, F.lit(0.25))).otherwise(cut),
        "new_position_allowed": heat < 0.6,
    }


def percent(x: Column, digits: int = 0) -> Column:
    """Percent text, ties to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(x * 100, digits))


def position_advice(heat, share, corr, factor, risk, weight, thresholds: dict[str, float] | None = None):
    """(recommendation, reason) of a position, first matching rule wins."""
    t = thresholds or C.THRESHOLDS
    critical = (heat >= t["critical"]) & (share > 0.15)
    hot = (heat >= t["hot"]) & (share > 0.20)
    by_corr = (corr > 0.25) & (heat >= t["warm"])
    by_factor = (factor > 0.25) & (heat >= t["warm"])
    calm = heat < t["warm"]
    heavy = (weight > 0.15) & (risk > 0.20)
    rec = (
        F.when(critical | hot, "reduce").when(by_corr | by_factor, "hedge").when(calm, "hold").otherwise("monitor")
    )
    reason = (
        F.when(critical, F.concat(F.lit("Top risk contributor ("), percent(share), F.lit(" of heat) during critical conditions")))
        .when(hot, F.concat(F.lit("Large heat share ("), percent(share), F.lit(") in hot conditions")))
        .when(by_corr, F.concat(F.lit("High correlation contribution ("), percent(corr), F.lit(") driving portfolio risk")))
        .when(by_factor, F.concat(F.lit("Concentrated factor exposure ("), percent(factor), F.lit(" of factor HHI)")))
        .when(calm, F.lit("Normal conditions, no action needed"))
        .when(heavy, F.concat(F.lit("Overweight ("), percent(weight), F.lit(") with elevated risk contribution ("), percent(risk), F.lit(")")))
        .otherwise(F.concat(F.lit("Heat share "), percent(share), F.lit(", monitoring")))
    )
    return rec, reason


def urgency(heat: Column, thresholds: dict[str, float] | None = None) -> Column:
    t = thresholds or C.THRESHOLDS
    return (
        F.when(heat >= t["emergency"], "immediate")
        .when(heat >= t["critical"], "today")
        .when(heat >= t["hot"], "this_week")
        .otherwise("optional")
    )


def fixed(x: Column, digits: int, plus: bool = False) -> Column:
    """Text of ``x`` with ``digits`` places, rounded as the binary value is: a tie is only what is one exactly, and goes to even.

    Exact below 32; beyond that decimal digits decide.
    """
    # the value times 2^98 as a whole number, from its upper and lower bits
    unit, ten = F.lit(str(1 << 98)).cast("decimal(30,0)"), 10**digits
    high = F.abs(x) * float(1 << 58)
    low = ((high - F.floor(high).cast("double")) * float(1 << 40)).cast("bigint").cast("decimal(13,0)")
    scaled = (F.floor(high).cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)") + low) * F.lit(ten).cast("decimal(4,0)")
    rest = scaled % unit
    whole = ((scaled - rest) / unit).cast("bigint")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    n = whole + up.cast("bigint")
    sign = F.when(x < 0, "-").otherwise("+" if plus else "")
    text = F.concat(sign, F.floor(n / ten).cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), digits, "0"))
    return F.when(F.abs(x) < 32, text).otherwise(F.format_string(f"%{'+' if plus else ''}.{digits}f", x))


def pretrade_verdict(after: Column, delta: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a what-if trade."""
    verdict = (
        F.when(after >= 0.7, "BLOCK")
        .when((after >= 0.6) | (delta > 0.1), "CAUTION")
        .when(delta > 0.05, "PROCEED_WITH_CARE")
        .otherwise("PROCEED")
    )
    push = lambda what: F.concat(F.lit("Would push heat to "), fixed(after, 2), F.lit(f" ({what})"))
    reason = (
        F.when(after >= 0.85, push("emergency"))
        .when(after >= 0.7, push("critical"))
        .when(after >= 0.6, push("hot"))
        .when(delta > 0.1, F.concat(F.lit("Significant heat increase: +"), fixed(delta, 3)))
        .when(delta > 0.05, F.concat(F.lit("Moderate heat increase: +"), fixed(delta, 3)))
        .otherwise(F.concat(F.lit("Minimal impact: "), fixed(delta, 3, plus=True)))
    )
    return verdict, reason


def normalise_vote(text: Column) -> Column:
    """yes/no from a word or a thumbs emoji, null when it is neither."""
    vote = F.lower(F.trim(text))
    bare = F.regexp_replace(vote, "[\\x{FE0F}\\x{1F3FB}-\\x{1F3FF}]", "")
    return (
        F.when(bare == "👍", "yes").when(bare == "👎", "no").when(vote.isin("yes", "no"), vote)
    )


def market_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, C.MARKET_ZONE))


def market_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, C.MARKET_ZONE), "HH:mm:ss")


def iso_week(day: Column) -> tuple[Column, Column]:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day)


def due_monday(local_ts: Column) -> Column:
    """Monday whose 16:30 slot fired last at local time ``local_ts``."""
    monday = F.to_date(F.date_trunc("week", local_ts))
    early = (F.weekday(local_ts) == 0) & (F.date_format(local_ts, "HH:mm") < "16:30")
    return F.when(early, F.date_sub(monday, 7)).otherwise(monday)


def is_weekly_slot(day: Column) -> Column:
    return F.weekday(day) == 0


def action_line(action: Column, symbol: Column, reason: Column, urgency_text: Column, has_package: Column) -> Column:
    """The one action line of a summary, or one of the two hold texts."""
    line = F.concat(F.upper(urgency_text), F.lit(": "), action, F.lit(" "), symbol, F.lit(" ("), reason, F.lit(")"))
    return F.coalesce(line, F.when(has_package, C.HOLD_NO_CHANGE).otherwise(C.HOLD_NO_SIGNAL))
