import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from barloom.operators.bars import carry_open, fill_gaps, ohlc
from barloom.operators.signals import best_per_interval
from barloom.sources.tables import messages, read_bars
from barloom.streaming import bars as S

TICKS = "key string, ts timestamp, seq bigint, price double"
BARS = "key string, tf_sec int, bar_start timestamp, open double, high double, low double, close double, n_ticks bigint"


def tick_rows(n=400, keys=("a", "b")):
    prices = [100 + ((i * 37) % 61) / 10 for i in range(n)]
    # Key b is silent now and then, which leaves empty minutes.
    return [
        (keys[i % 2], at(1704067200 + i * 11 + (600 if i > 250 and i % 2 else 0)), i, prices[i])
        for i in range(n)
    ]


def stream_of(spark, rows, schema, folder, files=4):
    """A file stream with the rows in order over several files, one file per micro-batch."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, mode="append", folder=None):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name)
    if folder:
        query = query.option("checkpointLocation", folder)
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return df.sparkSession.table(name)


# A last tick far ahead moves the watermark past every bar before it.
PUSH = [("z", at(1704067200 + 86400), 10**6, 1.0)]


@pytest.fixture()
def no_state_left(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    yield


def test_stream_bars_equal_batch_bars(spark, tmp_path, no_state_left):
    rows = tick_rows()
    stream = stream_of(spark, rows + PUSH, TICKS, str(tmp_path / "in"), files=3)
    got = drain(S.tick_bars(stream, 60), "bars_a").filter("key != 'z'")
    want = ohlc(spark.createDataFrame(rows, TICKS), 60).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_ticks_do_not_change_closed_bars(spark, tmp_path, no_state_left):
    rows = tick_rows(200)
    late = [("a", at(1704067200 + 5), 999, 500.0)]
    folder = str(tmp_path / "in")
    stream = stream_of(spark, rows + PUSH, TICKS, folder, files=1)
    out = str(tmp_path / "out")
    query = S.tick_bars(stream, 60, "1 minute").writeStream.format("parquet").option("path", out)
    query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    assert query.start().awaitTermination(180)
    before = spark.read.parquet(out).count()
    spark.createDataFrame(late, TICKS).coalesce(1).write.mode("append").parquet(folder)
    assert query.start().awaitTermination(180)
    got = spark.read.parquet(out)
    assert got.count() == before and got.agg(F.max("high")).first()[0] < 500


def test_carried_and_filled_stream_equals_batch(spark, tmp_path, no_state_left):
    rows = tick_rows()
    stream = stream_of(spark, rows + PUSH, TICKS, str(tmp_path / "in"), files=3)
    closed = S.tick_bars(stream, 60)
    stored = closed.writeStream.format("parquet").option("path", str(tmp_path / "bars"))
    stored = stored.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert stored.awaitTermination(180)
    bars = spark.readStream.schema(closed.schema).parquet(str(tmp_path / "bars"))
    got = drain(S.carried_bars(bars), "bars_c").filter("key != 'z'")
    batch = fill_gaps(carry_open(ohlc(spark.createDataFrame(rows, TICKS), 60))).select(*got.columns)
    assert got.count() > 0 and batch.filter("n_ticks = 0").count() > 0
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.key, {})[int(r.bar_start.timestamp())] = (r.open, r.high, r.low, r.close, r.n_ticks)
    return out


def test_silent_series_close_their_bars(spark, tmp_path, no_state_left):
    """No tick of a or b arrives after their last ones; their bars close all the same, then flat ones follow until too long idle."""
    rows = tick_rows(300)
    last = {k: max(int(r[1].timestamp()) for r in rows if r[0] == k) for k in "ab"}
    clock = [("z", at(1704067200 + 4200 + 60 * i), 10**6 + i, 1.0) for i in range(120)]
    stream = stream_of(spark, rows + clock, TICKS, str(tmp_path / "in"), files=5)
    got = by_key(drain(S.closing_bars(stream, 60, "1 minute", idle_seconds=3000), "closing"))
    want = by_key(fill_gaps(carry_open(ohlc(spark.createDataFrame(rows, TICKS), 60))))
    for key in "ab":
        starts = sorted(got[key])
        assert starts == list(range(starts[0], starts[-1] + 60, 60))
        assert {s: v for s, v in got[key].items() if s in want[key]} == want[key]
        assert starts[-1] == (last[key] + 3000) // 60 * 60 - 60
        close = want[key][max(want[key])][3]
        assert all(got[key][s] == (close, close, close, close, 0) for s in starts if s not in want[key])


def test_closing_bars_do_not_depend_on_batches(spark, tmp_path, no_state_left):
    rows = tick_rows()
    shuffled = [rows[i + d] for i in range(0, len(rows), 4) for d in (2, 0, 3, 1)]
    runs = []
    for i, (data, files) in enumerate(((rows, 1), (shuffled, 7))):
        stream = stream_of(spark, data + PUSH, TICKS, str(tmp_path / f"in{i}"), files=files)
        runs.append(by_key(drain(S.closing_bars(stream, 60, "2 minutes", idle_seconds=600), f"closing_{i}").filter("key != 'z'")))
    assert runs[0] == runs[1] and sum(map(len, runs[0].values())) > 150


def test_long_gaps_come_in_slices():
    bars = pd.DataFrame({"start": [60, 600_060], "open": [1.0, 2.0], "high": [3.0, 2.5], "low": [0.5, 2.0], "close": [1.5, 2.2], "n_ticks": [4, 2]})
    parts = list(S._carried("a", 60, bars, None, None, rows=1000))
    assert max(map(len, parts)) == 1000
    whole = pd.concat(parts)
    assert whole["start"].tolist() == list(range(60, 600_120, 60)) and whole["n_ticks"].sum() == 6
    assert whole.iloc[-1].tolist()[1:5] == [1.5, 2.5, 1.5, 2.2]


def test_open_bars_come_in_update_mode(spark, tmp_path):
    stream = stream_of(spark, tick_rows(60), TICKS, str(tmp_path / "in"), files=4)
    got = drain(S.tick_bars(stream, 3600), "bars_d", mode="update")
    assert got.filter("key = 'a'").count() > 1


def test_first_marker_wins(spark, tmp_path):
    rows = [("a", 60, at(1704067200 + 60 * (i % 5)), i) for i in range(20)]
    schema = "key string, tf_sec int, bar_start timestamp, no int"
    got = drain(S.first_markers(stream_of(spark, rows, schema, str(tmp_path / "in"))), "markers")
    assert got.count() == 5


def test_best_signal_per_minute(spark, tmp_path):
    schema = "key string, bar_start timestamp, seq bigint, confidence double"
    rows = [("ab"[i % 2], at(1704067200 + 15 * i), i, 0.6 + (i * 7 % 30) / 100) for i in range(60)]
    push = [("z", at(1704067200 + 86400), 10**6, 0.9)]
    stream = stream_of(spark, rows + push, schema, str(tmp_path / "in"), files=3)
    got = drain(S.best_signals(stream, lateness="1 hour"), "best").filter("key != 'z'")
    want = best_per_interval(spark.createDataFrame(rows, schema)).select(*got.columns)
    assert got.count() == 15 and got.exceptAll(want).count() == 0


def test_stream_against_static_calendar(spark, tmp_path):
    rows = [("a", 60, at(1704067200 + 60 * i), 1.0, 1.0, 1.0, 1.0, 1) for i in range(60)]
    news = spark.createDataFrame([("a", at(1704067200 + 1800)), ("b", at(1704067200))], "key string, ts timestamp")
    got = drain(S.news_blocked(stream_of(spark, rows, BARS, str(tmp_path / "in")), news, 300), "news")
    assert got.count() == 11


def test_stored_stream_replaces_and_keeps(spark, tmp_path):
    first = [("a", 60, at(1704067200 + 60 * i), 1.0, 1.0, 1.0, float(i), 1) for i in range(10)]
    second = [("a", 60, at(1704067200 + 60 * i), 1.0, 1.0, 1.0, 100.0 + i, 1) for i in range(8, 12)]
    folder, target, check = (str(tmp_path / x) for x in ("in", "bars", "check"))
    stream = stream_of(spark, first, BARS, folder, files=1)
    assert S.store_bars(stream, target, check).awaitTermination(180)
    spark.createDataFrame(second, BARS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(BARS).parquet(folder)
    assert S.store_bars(stream, target, check).awaitTermination(180)
    got = read_bars(spark, target, ["a"], 60).orderBy("bar_start").toPandas()
    assert got["close"].tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 108, 109, 110, 111]


def test_published_messages_lie_by_topic(spark, tmp_path):
    rows = [(k, 60, at(1704067200 + 60 * i), 1.0, 2.0, 0.5, 1.5, 1) for k in "ab" for i in range(3)]
    stream = stream_of(spark, rows, BARS, str(tmp_path / "in"), files=1)
    assert S.publish(messages(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(180)
    got = spark.read.json(str(tmp_path / "out")).groupBy("topic").count().toPandas()
    assert dict(zip(got["topic"], got["count"])) == {"candle:a:60": 3, "candle:b:60": 3}


def test_carried_closes_stay_in_their_timeframe(spark, tmp_path):
    from barloom.streaming.bars import carried_bars

    rows = [("a", tf, at(1704067200 + tf * i), p, p + 1, p - 1, p + 0.5, 3) for tf, base in ((60, 10.0), (300, 50.0)) for i, p in ((0, base), (1, base + 1), (3, base + 3))]
    schema = "key string, tf_sec int, bar_start timestamp, open double, high double, low double, close double, n_ticks bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = carried_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("two_timeframes").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.tf_sec, int(r.bar_start.timestamp())): (r.open, r.close) for r in spark.table("two_timeframes").collect()}
    for tf, base in ((60, 10.0), (300, 50.0)):
        mine = [got[tf, 1704067200 + tf * i] for i in range(4)]
        assert mine == [(base, base + 0.5), (base + 0.5, base + 1.5), (base + 1.5, base + 1.5), (base + 1.5, base + 3.5)]
    assert len(got) == 8


def test_newest_rows_are_limited_before_they_move(spark):
    from barloom.operators.retention import newest_rows

    df = spark.range(5000).selectExpr("id % 3 AS key", "60 AS tf_sec", "timestamp_seconds(id) AS bar_start")
    newest = newest_rows(df, 5)
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    assert sorted(int(r.bar_start.timestamp()) for r in newest.collect()) == list(range(4985, 5000))
