"""The bar store: versions, tokens, modes, deletions, generations; dead letters that are written again; windows of streams."""

from __future__ import annotations

from collections import defaultdict

import pytest
from oracle_check import agree
from pyspark.sql import functions as F

from tapeloom import plugins
from tapeloom.operators import bars as B
from tapeloom.plans import catalog
from tapeloom.sources.sinks import BarStore
from tapeloom.streaming import live

SF = "/root/testdata/sf0.001"


def bar(symbol="a", i=0, close=1.0, volume=1.0, threshold=250):
    return (symbol, threshold, 0, i, i * 100, i * 100 + 50, 1.0, max(close, 1.0), min(close, 1.0), close, volume, 5, i * 10, i * 10 + 4)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, threshold int, segment long, bar_id long, open_time long, close_time long, open double, high double, low double, close double, volume double, individual_trade_count long, first_trade_id long, last_trade_id long")


def held(store, **how):
    return sorted((r.symbol, r.threshold, r.bar_id, r.close) for r in store.read(**how).collect())


def test_versions_tokens_and_ranges(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    assert store.write(frame(spark, bar(i=0), bar(i=1), bar(i=2, volume=-1.0)), 1, "x")
    assert not store.write(frame(spark, bar(i=0, close=9.0)), 5, "x")
    store.write(frame(spark, bar(i=1, close=2.0)), 2)
    assert held(store) == [("a", 250, 0, 1.0), ("a", 250, 1, 2.0)]
    assert held(store, since=100) == held(store, least_version=2) == [("a", 250, 1, 2.0)] and held(store, until=60) == [("a", 250, 0, 1.0)]
    assert held(store, mode="month") == [] and len(held(store, mode="none")) == 2


def test_a_series_has_one_mode(spark, tmp_path):
    BarStore(spark, f"{tmp_path}/s").write(frame(spark, bar()), 1)
    monthly = BarStore(spark, f"{tmp_path}/s", "month")
    with pytest.raises(ValueError, match="mode none, not month"):
        monthly.write(frame(spark, bar(i=1)), 1)
    monthly.write(frame(spark, bar(threshold=500)), 1)
    assert held(monthly, mode="month") == [("a", 500, 0, 1.0)]


def test_deletions_hold_for_the_versions_before_them(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s")
    store.write(frame(spark, *[bar(s, i, threshold=t) for s in "ab" for i in range(4) for t in (250, 500)]), 1)
    store.invalidate("a", 1, 250, 100, 200)
    store.invalidate("b", 1, 500)
    left = [("a", 250, 0), ("a", 250, 3), *[("a", 500, i) for i in range(4)], *[("b", 250, i) for i in range(4)]]
    assert [r[:3] for r in held(store)] == left
    store.write(frame(spark, bar("b", 2, 3.0, threshold=500)), 2)
    assert [r[:3] for r in held(store)] == [*left, ("b", 500, 2)]
    store.compact()
    assert store.generation() == 1 and [r[:3] for r in held(store)] == [*left, ("b", 500, 2)]
    store.write(frame(spark, bar("b", 3, 3.0, threshold=500)), 3)
    store.compact(now_us=400, keep_us=100)
    assert [r[:3] for r in held(store)] == [("a", 250, 3), ("a", 500, 3), ("b", 250, 3), ("b", 500, 3)]


def test_what_could_not_be_written_is_written_again(spark, tmp_path, monkeypatch):
    trades = catalog.trades(spark, SF)
    stream = live.streaming_bars(live._as_stream(spark, trades, str(tmp_path), 1))
    write = BarStore.write
    monkeypatch.setattr(BarStore, "write", lambda *a, **k: 1 / 0)
    monkeypatch.setattr("tapeloom.sources.paged.retried.__defaults__", (5, 0.0, 0.0, lambda wait: None))
    live.into_store(spark, stream, f"{tmp_path}/store", f"{tmp_path}/state").awaitTermination()
    monkeypatch.setattr(BarStore, "write", write)
    store = BarStore(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    assert live.replay_dead(spark, f"{tmp_path}/store") == 1 and live.replay_dead(spark, f"{tmp_path}/store") == 0
    assert store.read().count() == B.range_bars(trades).count()


def test_callbacks_hear_of_writes_and_providers_need_their_bars(spark, tmp_path, monkeypatch):
    heard = []
    monkeypatch.setattr(plugins, "_hooks", defaultdict(list))
    plugins.on("bars_stored", lambda **what: heard.append(what["version"]))
    plugins.on("bars_stored", lambda **what: 1 / 0)
    plugins.on("bars_deleted", lambda **what: heard.append(what["symbol"]))
    store = BarStore(spark, f"{tmp_path}/s")
    bars = frame(spark, *[bar("a", i) for i in range(3)], bar("b", 0))
    store.write(bars, 4, "x")
    store.write(bars, 5, "x")
    store.invalidate("a", 4)
    assert heard == [4, "a"]
    twice = plugins.Provider("twice", "1", ["twice"], lambda b: b.withColumn("twice", F.col("close") * 2), min_bars=2)
    assert sorted((r.symbol, r.twice) for r in plugins.enriched(bars, [twice]).filter("bar_id = 0").collect()) == [("a", 2.0), ("b", None)]


@pytest.mark.parametrize("name", ["rb_populate", "rb_precompute", "rb_count_bounded", "so_invalidate", "so_retention", "snk_store", "str_state", "str_backpressure", "str_window_tumbling", "str_window_sliding", "str_window_session", "str_sidecar"])
def test_agrees_with_sql(spark, name):
    agree(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_a_trade_after_the_watermark_is_passed_over(spark, tmp_path):
    hour = 3_600_000_000
    rows = [("a", i, 100, 1, i, i, at, False) for i, at in enumerate([0, 1, 3 * hour, 5, 3 * hour + 9, 6 * hour])]
    trades = spark.createDataFrame(rows, "symbol string, agg_trade_id long, price_fp long, volume_fp long, first_trade_id long, last_trade_id long, ts_us long, is_buyer_maker boolean")
    for k, ids in enumerate(([0, 1], [2], [4], [3], [5])):  # trade 3 comes when its window has come out
        trades.filter(F.col("agg_trade_id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = spark.read.parquet(live._drained(live.windowed(stream), str(tmp_path), "append"))
    assert sorted((r.start_us, r.n) for r in got.collect()) == [(0, 2), (3 * hour, 2)]
