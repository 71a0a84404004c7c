import datetime as dt
import json

from pyspark.sql import functions as F

from bookheat.session import scratch_path
from bookheat.sources import io as IO
from bookheat.streaming import book_log as L
from bookheat.streaming import jobs as J
from bookheat.streaming import refresh
from bookheat.streaming.refresh import heat_refresh

READ = "book_id long, ts timestamp, seq long, level string, regime string"


def reading(minute, level, regime="normal", book=1, seq=None):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return (book, ts, minute if seq is None else seq, level, regime)


def test_alert_rules_batch(spark):
    rows = [
        reading(0, "emergency"), reading(5, "emergency"), reading(10, "cool"), reading(20, "hot"), reading(50, "cool"),
        reading(55, "cool", "crisis"), reading(60, "cool", "unknown"), reading(61, "cool", "crisis"), reading(365, "emergency"),
    ]
    got = {(r.seq, r.tier) for r in J.alert_batch(spark.createDataFrame(rows, READ)).collect()}
    # the change at 20 falls in the cooldown of the one at 10 and is lost, the shift at 61 in that of 55
    assert got == {
        (0, "emergency"), (10, "level_change"), (50, "level_change"), (55, "regime_shift"), (365, "emergency"),
        (365, "level_change"), (365, "regime_shift"),
    }


def streamed_alerts(spark, rows, batches, delay="2 hours"):
    """Alerts of readings that arrive in the given micro-batches; a last reading of another book moves the watermark on."""
    path = scratch_path(spark, "readings")
    for part in [*batches, [reading(100_000, "cool", book=99)]]:
        spark.createDataFrame(part, READ).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).parquet(path)
    out = J.run_available(J.alert_stream(stream, delay=delay), "append", "alerts")
    return {(r.book_id, r.seq, r.tier) for r in spark.read.schema(J.ALERT_OUT).parquet(f"{out}/batch=*").collect()}


def test_alert_stream_judges_readings_in_order_of_time(spark):
    import random

    rows = [reading(i * 7, ["cool", "hot", "emergency"][(i * i) % 3], ["normal", "crisis"][i // 9 % 2], b) for i in range(40) for b in (1, 2)]
    want = {(r.book_id, r.seq, r.tier) for r in J.alert_batch(spark.createDataFrame(rows, READ)).collect()}
    assert len(want) > 10
    # in three batches, and with neighbours that arrive in another order and another batch
    assert streamed_alerts(spark, rows, [rows[:20], rows[20:50], rows[50:]]) == want
    mixed = sorted(rows, key=lambda r: (r[2] + random.Random(r[2] * 10 + r[0]).uniform(0, 100)))
    assert mixed != rows
    assert streamed_alerts(spark, rows, [mixed[:25], mixed[25:55], mixed[55:]]) == want


def test_first_write_wins_across_batches(spark):
    path = scratch_path(spark, "rows")
    for v in (1.0, 2.0):
        spark.createDataFrame([(1, dt.date(2024, 1, 2), v), (1, dt.date(2024, 1, 3), v)], "book_id int, date date, score double").coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("book_id int, date date, score double").option("maxFilesPerTrigger", 1).parquet(path)
    out = J.run_available(J.first_per_date(s, ["book_id"], "2 days"), "append", "first")
    rows = spark.read.parquet(f"{out}/batch=*").collect()
    assert sorted((r.date.day, r.score) for r in rows) == [(2, 1.0), (3, 1.0)]


def test_books_are_replaced_whole_and_valid_only(spark):
    cols = "book_id int, symbol string, weight double"
    asked = cols + ", version int, positions long"
    start = spark.createDataFrame([(1, "A", 1.0), (2, "A", 1.0), (3, "A", 1.0), (4, "A", 1.0)], cols)
    path = scratch_path(spark, "cand")
    batches = [
        [(1, "B", 0.5, 1, 2), (2, "B", 0.4, 1, 1), (3, "B", 0.5, 1, 2)],
        [(1, "C", 0.5, 1, 2), (4, "B", 1.0, 1, 1)],
        [(1, "D", 9.0, 2, 1), (4, "C", 1.0, 3, 1), (4, "D", 1.0, 2, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, asked).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(asked).option("maxFilesPerTrigger", 1).parquet(path)
    out = L.current_books(spark, L.book_updates(s, start), start).collect()
    # 1 arrives in two parts, 2 is invalid, 3 stays incomplete, 4 takes its newest version
    assert {(r.book_id, r.symbol) for r in out} == {(1, "B"), (1, "C"), (2, "A"), (3, "A"), (4, "C")}


def test_calibration_formats(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"absorption_ratio": 0.5, "turbulence": 1.0, "div_ratio": 2.0, "factor_hhi": 0.1, "avg_corr": 0.3}]))
    (tmp_path / "dict.json").write_text(json.dumps({k: [0.1, 0.2] for k in IO.SEED_FIELDS}))
    assert [r.dr for r in IO.load_calibration(spark, str(tmp_path / "list.json")).collect()] == [0.5]
    assert [r.ar for r in IO.load_calibration(spark, str(tmp_path / "dict.json")).collect()] == [0.1, 0.2]


def test_ledger_skips_corrupt_and_blank_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"channel": 1, "tier": "daily_summary"}\n\n{broken\n{"channel": 2}\n')
    got = IO.read_ledger(spark, str(tmp_path / "log.jsonl")).collect()
    assert sorted(r.channel for r in got) == [1, 2]


def heat_inputs(spark, weeks):
    import numpy as np

    rng = np.random.default_rng(8)
    names = [f"S{i}" for i in range(5)] + [f"F{i}" for i in range(2)]
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (weeks, len(names))), axis=0))
    rows = [(dt.date(2020, 1, 6) + dt.timedelta(weeks=w), n, float(prices[w, k])) for w in range(weeks) for k, n in enumerate(names)]
    closes = spark.createDataFrame(rows, "date date, symbol string, close double")
    books = spark.createDataFrame([("b", f"S{i}", 0.2) for i in range(5)], "book_id string, symbol string, weight double")
    factors = spark.createDataFrame([("F0", "market"), ("F1", "momentum")], "symbol string, factor string")
    return closes, books, factors


def refreshed(spark, parts, books, factors, **sizes):
    """The heat table after the given micro-batches, one file each."""
    from bookheat.session import scratch_path

    path = scratch_path(spark, "refresh-test")
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = heat_refresh(stream, books, factors, **sizes)
    return {(r.date, round(r.score, 10)) for r in spark.read.parquet(f"{out}/batch=*").collect()}


def test_heat_refresh_makes_up_for_a_short_first_batch(spark):
    from bookheat.operators import heat as H
    from bookheat.operators import panel as P

    closes, books, factors = heat_inputs(spark, 90)
    whole = {(r.date, round(r.score, 10)) for r in H.rolling_heat(books, P.log_returns(closes), factors).collect()}
    cut = dt.date(2020, 1, 6) + dt.timedelta(weeks=30)
    early, late = closes.filter(closes.date < cut), closes.filter(closes.date >= cut)
    assert len(whole) == 29
    assert refreshed(spark, [early, late], books, factors) == whole
    assert refreshed(spark, [early, late, late.limit(0)], books, factors) == whole


def test_heat_refresh_scores_late_days(spark):
    closes, books, factors = heat_inputs(spark, 80)
    hole = dt.date(2020, 1, 6) + dt.timedelta(weeks=70)
    got = refreshed(spark, [closes.filter(closes.date != hole), closes.filter(closes.date == hole)], books, factors)
    assert hole in {d for d, _ in got} and len(got) == 19


def test_heat_refresh_reads_no_more_as_history_grows(spark, monkeypatch):
    """Twenty weekly batches after a long start: each reads as many rows as the first of them, and the scores are the batch scores."""
    from bookheat.operators import heat as H
    from bookheat.operators import panel as P

    closes, books, factors = heat_inputs(spark, 160)
    read = {}
    real = refresh.Months.since

    def counted(self, month, batch_id, included, only=False):
        out = real(self, month, batch_id, included, only)
        read[batch_id] = read.get(batch_id, 0) + out.count()
        return out

    monkeypatch.setattr(refresh.Months, "since", counted)
    start = dt.date(2020, 1, 6)
    cuts = [start, *[start + dt.timedelta(weeks=140 + k) for k in range(21)]]
    parts = [closes.filter((F.col("date") >= a) & (F.col("date") < b)) for a, b in zip(cuts, cuts[1:])]
    got = refreshed(spark, parts, books, factors, window=20, history=30)
    returns = P.log_returns(closes)
    whole = H.blend(H.components(books, P.windows(returns, "simple", 20, include_current=False), factors), rows=30)
    assert got == {(r.date, round(r.score, 10)) for r in whole.collect()}
    later = [read[k] for k in range(1, 21)]
    # whole months are read, so the number moves by a few weeks of rows
    assert max(later) < 1.6 * min(later) and max(later) < 1500


def test_months_replace_the_rows_of_a_batch_that_runs_again(spark):
    store = refresh.Months(spark, scratch_path(spark, "months"), "date date, v int")
    put = lambda rows, b: store.put(spark.createDataFrame(rows, "date date, v int"), b)
    put([(dt.date(2024, 1, 2), 1), (dt.date(2024, 2, 2), 2)], 0)
    put([(dt.date(2024, 2, 3), 3)], 1)
    put([(dt.date(2024, 2, 3), 4)], 1)
    rows = lambda *a, **k: sorted(r.v for r in store.since(*a, **k).collect())
    assert rows("2024-01", 1, True) == [1, 2, 4] and rows("2024-02", 1, False) == [2] and rows("2024-02", 1, True, only=True) == [4]
    assert rows("2024-03", 1, True) == [] and store.months() == ["2024-01", "2024-02"]


BOOK = "book_id int, symbol string, weight double"


def updated(spark, batches, start, **options):
    """Path of the book table after the given micro-batches of (book, symbol, weight, version, positions)."""
    path = scratch_path(spark, "asked")
    asked = BOOK + ", version int, positions long"
    for rows in batches:
        spark.createDataFrame(rows, asked).coalesce(1).write.mode("append").parquet(path)
    return L.book_updates(spark.readStream.schema(asked).option("maxFilesPerTrigger", 1).parquet(path), start, **options)


def test_deleted_books_come_back_only_with_a_new_version(spark):
    start = spark.createDataFrame([(1, "A", 1.0), (2, "A", 1.0), (3, "A", 1.0)], BOOK)
    batches = [[(1, None, None, 1, 0), (2, None, None, 1, 0)], [(2, "B", 1.0, 2, 1), (1, "X", 1.0, 1, 1)]]
    out = L.current_books(spark, updated(spark, batches, start, buckets=2), start, 2).collect()
    # the row for 1 belongs to the version that deleted it
    assert {(r.book_id, r.symbol) for r in out} == {(2, "B"), (3, "A")}


def test_a_batch_writes_its_books_only_and_segments_merge(spark, monkeypatch):
    monkeypatch.setattr(L, "SMALL", 4)
    wrote, read = [], []
    real_write, real_read = L.Log._write, L.Log.read

    def write(self, rows, name):
        n = real_write(self, rows, name)
        if self.path.endswith("-table"):
            wrote.append((name, n))
        return n

    def seen(self, segments, books=None):
        if books is not None:
            read.append(real_read(self, segments, books).count())
        return real_read(self, segments, books)

    monkeypatch.setattr(L.Log, "_write", write)
    monkeypatch.setattr(L.Log, "read", seen)
    start = spark.createDataFrame([(b, s, 0.5) for b in range(200) for s in "AB"], BOOK)
    batches = [[(k, "C", 0.5, 1, 2), (k, "D", 0.5, 1, 2)] for k in range(20)]
    path = updated(spark, batches, start, buckets=2)
    got = {(r.book_id, r.symbol) for r in L.current_books(spark, path, start, 2).collect()}
    assert got == {(b, s) for b in range(200) for s in ("CD" if b < 20 else "AB")}
    assert [n for name, n in wrote if name.startswith("segment=b")] == [400] + [2] * 20
    # merging touches small segments, never the table they update
    merged = sum(n for name, n in wrote if name.startswith("segment=m"))
    assert 0 < merged <= 2 * 20 * 3
    assert max(read) <= 2
    log = L._log(spark, path, start, 2)
    assert len(log.manifest()) <= 2 * L.FAN + 1
    log.vacuum()
    assert {(r.book_id, r.symbol) for r in L.current_books(spark, path, start, 2).collect()} == got


def test_a_batch_that_runs_again_changes_nothing(spark):
    log = L.Log(spark, scratch_path(spark, "log"), "book_id int, symbol string, seq long", buckets=2)
    rows = lambda *r: spark.createDataFrame(r, "book_id int, symbol string, seq long")
    log.commit(rows((1, "A", 0), (2, "A", 0)), -1)
    for _ in range(2):
        log.commit(rows((1, "B", 1)), 0)
    log._write(rows((2, "torn", 2)), "segment=b1")  # written, but the batch never came to its manifest
    assert {(r.book_id, r.symbol) for r in log.newest(log.read(log.manifest())).collect()} == {(1, "B"), (2, "A")}
    log.commit(rows(), 1)
    assert len(log.manifest()) == 2


def test_history_of_a_changed_book_starts_again(spark):
    day = lambda k: dt.date(2024, 1, k)
    history = spark.createDataFrame([(b, day(k), "A") for b in (1, 2) for k in range(1, 6)], "book_id int, date date, symbol string")
    changes = spark.createDataFrame([(1, day(2)), (1, day(4)), (3, day(1))], "book_id int, changed_on date")
    got = sorted((r.book_id, r.date.day) for r in L.live_history(history, changes).collect())
    assert got == [(1, 4), (1, 5)] + [(2, k) for k in range(1, 6)]
