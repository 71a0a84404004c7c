import pytest
from pyspark.sql import functions as F

from bookheat.functions import rules as R


def values(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_levels_and_actions(spark):
    got = values(
        spark, [(0.1,), (0.4636,), (0.7,), (0.81,), (0.9,)], "s double", R.classify_heat(F.col("s")).alias("l"),
        R.heat_action(R.classify_heat(F.col("s"))).alias("a"),
    )
    assert [r.l for r in got] == ["cool", "warm", "hot", "critical", "emergency"]
    assert got[0].a == "Normal trading, full position sizes"


def test_kelly_shrinks_with_heat_and_regime(spark):
    k = R.kelly(F.lit(0.02), F.lit(0.04), F.col("h"), F.col("r"))
    got = values(
        spark, [(0.1, "low_vol"), (0.5, "low_vol"), (0.5, "crisis"), (0.85, "normal"), (0.1, "odd")],
        "h double, r string", k["kelly_adjusted"].alias("k"), k["action"].alias("a"),
    )
    ks = [r.k for r in got]
    assert ks[0] == pytest.approx(0.25)
    assert ks[0] > ks[1] > ks[2] > ks[3] == 0
    assert ks[4] == pytest.approx(0.25 * 0.75)
    assert got[3].a.startswith("HALT")
    skip = R.kelly(F.lit(0.02), F.col("v"), F.lit(0.1), F.lit("normal"))
    assert values(spark, [(0.0,)], "v double", skip["action"].alias("a"))[0].a.startswith("SKIP")


def test_exposure_limits(spark):
    lim = R.exposure_limits(F.col("h"), F.lit(1.0), F.col("r"))
    got = values(
        spark, [(0.1, "normal"), (0.1, "crisis"), (0.45, "normal"), (0.65, "normal"), (0.9, "crisis")], "h double, r string",
        lim["max_exposure"].alias("m"), lim["target_reduction"].alias("t"), lim["new_position_allowed"].alias("n"),
    )
    assert [(round(r.m, 4), r.t, r.n) for r in got] == [
        (1.0, 0.0, True), (0.75, 0.25, True), (0.75, 0.25, True), (0.75, 0.25, False), (0.375, 0.5, False),
    ]


def test_crowding_alpha_is_contrarian(spark):
    got = values(spark, [(0.95,), (0.8,), (0.5,), (0.1,)], "p double", R.crowding_alpha(F.col("p")).alias("a"))
    assert [round(r.a, 4) for r in got] == [-0.9, -0.3, 0.0, 0.2]


def test_votes(spark):
    words = [("yes",), (" No ",), ("👍🏽",), ("👎️",), ("maybe",)]
    got = values(spark, words, "v string", R.normalise_vote(F.col("v")).alias("x"))
    assert [r.x for r in got] == ["yes", "no", "yes", "no", None]


def test_due_monday(spark):
    rows = [("2026-10-05 16:29:00",), ("2026-10-05 16:30:00",), ("2026-10-07 01:00:00",)]
    got = values(spark, rows, "t string", R.due_monday(F.to_timestamp("t")).cast("string").alias("d"))
    assert [r.d for r in got] == ["2026-09-28", "2026-10-05", "2026-10-05"]


def test_advice_order(spark):
    rec, why = R.position_advice(*[F.col(c) for c in "hscfrw"])
    rows = [(0.85, 0.16, 0, 0, 0, 0), (0.7, 0.21, 0, 0, 0, 0), (0.5, 0.1, 0.3, 0.3, 0, 0), (0.5, 0.1, 0.1, 0.3, 0, 0), (0.2, 0.9, 0.9, 0.9, 0, 0), (0.5, 0.1, 0.1, 0.1, 0.3, 0.2)]
    got = values(spark, [tuple(map(float, r)) for r in rows], "h double, s double, c double, f double, r double, w double", rec.alias("x"), why.alias("y"))
    assert [r.x for r in got] == ["reduce", "reduce", "hedge", "hedge", "hold", "monitor"]
    assert got[0].y == "Top risk contributor (16% of heat) during critical conditions"
    assert got[5].y.startswith("Overweight (20%)")
