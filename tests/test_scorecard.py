import datetime as dt

import pytest

from bookheat.operators import scorecard as K
from bookheat.operators import signals as S


def series(spark, values, column, start=dt.date(2024, 1, 2), symbol="X"):
    days, d = [], start
    while len(days) < len(values):
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    rows = [(symbol, d, float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, f"symbol string, date date, {column} double")


def test_two_episodes(spark):
    closes = series(spark, [100, 95, 90, 95, 100, 100, 97, 94, 97, 100, 101], "close")
    got = K.drawdown_episodes(closes).orderBy("peak_date").collect()
    assert [round(r.depth, 6) for r in got] == [-0.1, -0.06]
    assert got[0].peak_date == dt.date(2024, 1, 2) and got[0].trough_date == dt.date(2024, 1, 4)
    assert got[0].recovery_date == dt.date(2024, 1, 8)
    assert got[1].peak_date == dt.date(2024, 1, 9)


def test_shallow_and_unrecovered(spark):
    assert K.drawdown_episodes(series(spark, [100, 99, 98, 100], "close")).count() == 0
    open_end = K.drawdown_episodes(series(spark, [100, 95, 90], "close")).collect()
    assert len(open_end) == 1 and open_end[0].recovery_date is None


def test_leads(spark):
    closes = series(spark, [100, 100, 100, 100, 97, 94, 92, 96, 100], "close")
    vix = series(spark, [20, 20, 20, 20, 20, 26, 27, 21, 20], "vix").drop("symbol")
    w = K.warning_leads(closes, vix, K.drawdown_episodes(closes), 25.0, 3).collect()[0]
    assert (w.ma_days, w.vix_days) == (3, 2)
    assert w.vix_lead == 1 and w.ma_lead == 2
    card = K.scorecard(closes, K.warning_leads(closes, vix, K.drawdown_episodes(closes), 25.0, 3))
    c = card.collect()[0]
    assert (c.episodes, c.vix_fired, c.either_median_lead) == (1, 1, 2.0)
    text = K.scorecard_text(card, K.warning_leads(closes, vix, K.drawdown_episodes(closes), 25.0, 3)).collect()[0].text
    assert "1. 2024-01-05→2024-01-10 -8.0% (5d, recovered) | VIX HIT +1d | MA HIT +2d" in text


def test_strategy_lag(spark):
    rows = [("b", "heat", 0, dt.date(2024, 1, 1) + dt.timedelta(days=i), -0.1 if i == 5 else 0.01, int(i == 5)) for i in range(12)]
    sig = spark.createDataFrame(rows, "book_id string, signal string, ordinal int, date date, ret double, fired int")
    same, late = S.signal_strategy(sig, "exit").collect()[0], S.signal_strategy(sig, "exit", lag=1).collect()[0]
    assert same.strategy_return == pytest.approx(1.01**11 - 1)
    assert late.strategy_return < same.strategy_return
