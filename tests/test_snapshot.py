import datetime as dt

from bookheat.operators.snapshot import portfolio_states


def test_one_row_per_book_with_what_it_has(spark):
    day = lambda k: dt.date(2024, 1, k)
    heat = spark.createDataFrame([(1, day(1), 0.2, "cool", 0.1), (1, day(2), 0.7, "hot", 0.4)], "book_id int, date date, score double, level string, avg_corr double")
    books = spark.createDataFrame([(1, "A", 0.3), (1, "B", 0.7), (2, "A", 1.0)], "book_id int, symbol string, weight double")
    exposures = spark.createDataFrame([(1, "value", -0.2, 0.2), (1, "market", 0.8, 0.8)], "book_id int, factor string, total_exposure double, exposure_share double")
    recs = spark.createDataFrame([(1, 2, "trim", "B", -0.1, "today", "y"), (1, 1, "hedge", "X", 0.1, "now", "x")], "book_id int, priority int, action string, instrument string, delta double, urgency string, why string")
    limits = spark.createDataFrame([(1, 0.8, True), (3, 0.1, False)], "book_id int, max_exposure double, new_position_allowed boolean")
    got = {r.book_id: r for r in portfolio_states(heat, limits=limits, positions=books, factor_exposures=exposures, recommendations=recs).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.heat.date, one.heat.level, one.correlation_avg) == (day(2), "hot", 0.4) and one.throttle.max_exposure == 0.8
    assert [tuple(p) for p in one.positions] == [(0.7, "B"), (0.3, "A")]
    assert [e.factor for e in one.factor_exposures] == ["market", "value"] and [r.action for r in one.recommendations] == ["hedge", "trim"]
    assert two.heat is None and two.throttle is None and two.recommendations is None and [tuple(p) for p in two.positions] == [(1.0, "A")]
