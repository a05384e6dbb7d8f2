"""Continuity presets, the second tier, frames from elsewhere, pages by time."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import analytics as A
from tapeloom.operators import quality as Q
from tapeloom.operators.spread import price_hash
from tapeloom.plans import catalog
from tapeloom.sources import paged
from tapeloom.sources.sinks import from_frame

SF = "/root/testdata/sf0.001"


def series(spark, gaps, symbol="abc", threshold=250):
    rows, close = [], 100.0
    for i, g in enumerate([0.0, *gaps]):
        rows.append((symbol, threshold, 0, i, close * (1 + g), 100.0))
    return spark.createDataFrame(rows, "symbol string, threshold int, segment long, bar_id long, open double, close double")


def test_presets_say_what_is_over_them(spark):
    bars = series(spark, [0.0, 5e-6, 5e-5, 5e-4, 5e-3, 0.012, 0.2])
    got = Q.continuity(bars, "standard").first()
    assert [got[t] for t in Q.TIERS] == [2, 1, 1, 2, 1] and (got.n_bars, got.n_over, got.is_valid, got.verdict) == (8, 2, False, "warn")
    assert Q.continuity(bars, "strict").first().verdict == "error" and Q.continuity(bars, (0.3, "error")).first().verdict == "ok"
    skipped = Q.continuity(bars, "skip").first()
    assert (skipped.verdict, skipped.is_valid, skipped.n_over) == ("skipped", True, 0)
    assert Q.continuity(series(spark, []), "paranoid").first().verdict == "ok"
    small = Q.continuity(series(spark, [5e-5]), (2e-5, "error")).first()
    assert (small.n_over, small.verdict) == (1, "ok")  # over the tolerance, but noise
    with pytest.raises(ValueError, match="mode"):
        Q.continuity(bars, (0.1, "shout"))


def test_modes_raise_warn_or_pass(spark):
    bars = series(spark, [0.015])
    with pytest.raises(Q.ContinuityError, match="abc at 250: 1 gaps"):
        Q.continuous(bars, "audit")
    with pytest.warns(UserWarning, match="1.5000%"):
        assert Q.continuous(bars, "standard") is bars
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert Q.continuous(bars, "skip") is bars and Q.continuous(series(spark, [0.015], "BTCUSDT"), "auto") is not None
        with pytest.raises(UserWarning):
            Q.continuous(series(spark, [0.015], "EURUSD"), "auto")


def test_second_tier_needs_three_features_that_tell(spark):
    n = 400
    rows = [("s", 250, 0, i, 100 + (i * 7919 % 101) / 50) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, threshold int, segment long, bar_id long, close double")
    ahead = F.lead("close").over(A.R.series()) / F.col("close") - 1
    bars = bars.withColumn("_r", F.coalesce(ahead, F.lit(0.0))).withColumn("noise", (F.col("bar_id") * 104729 % 997) / 997)
    told = ("duration_us", "trade_intensity", "volume_per_trade")
    full = bars.withColumns({f: F.col("_r") * 10 + F.col("noise") / 100 if f in told else F.col("noise") for f in A.FEATURES}).withColumn("volume", F.lit(1.0)).drop("_r", "noise")
    found = {r.feature: r for r in A.second_tier(full).collect()}
    assert set(found) == set(A.FEATURES) and all(found[f].significant for f in told) and found["ofi"].n_significant >= 3
    one = {r.feature: r for r in A.second_tier(full.withColumns({f: F.lit(1.0) for f in A.FEATURES if f != "duration_us"})).collect()}
    assert not any(r.passed for r in one.values()) and not one["ofi"].significant
    assert A.second_tier(full.filter("bar_id < 80")).count() == 0


def test_frames_are_checked(spark):
    row = {"symbol": "a", "threshold": 250, "open_time": 1, "close_time": 2, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 1.0, "individual_trade_count": 1, "first_trade_id": 1, "last_trade_id": 1}
    bad = [{"close_time": 1}, {"high": 1.2}, {"volume": 0.0}, {"individual_trade_count": 0}, {"last_trade_id": 0}, {"close": None}]
    frame = spark.createDataFrame([{**row, **b, "k": k} for k, b in enumerate([{}, *bad])], "symbol string, threshold int, open_time long, close_time long, open double, high double, low double, close double, volume double, individual_trade_count long, first_trade_id long, last_trade_id long, k int")
    good, rest = from_frame(frame)
    assert [r.k for r in good.collect()] == [0]
    assert [r.reason for r in rest.orderBy("k").collect()] == ["time", "prices", "volume", "count", "ids", "null"]
    with pytest.raises(ValueError, match="close_time, volume"):
        from_frame(frame.drop("close_time", "volume"))


def tied(symbol, from_us, limit):
    """Trades of which many share a time."""
    every = [{"symbol": symbol, "agg_trade_id": i, "timestamp": i // 7 if i < 70 else 10 if i < 130 else i - 100} for i in range(150)]
    return [t for t in every if t["timestamp"] >= from_us][:limit]


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_pages_by_time_lose_and_double_nothing(monkeypatch, size):
    monkeypatch.setattr(paged, "tied", tied, raising=False)
    options = {"symbol": "a", "fetch": "tapeloom.sources.paged:tied", "pageSize": size}
    for first, end in ((0, 1000), (3, 11), (10, 11), (500, 900)):
        want = [t["agg_trade_id"] for t in tied("a", first, 10**6) if t["timestamp"] < end]
        assert [r[1] for r in paged._pages_by_time(options, first, end)] == want


def test_price_hash_tells_other_prices(spark):
    trades = catalog.trades(spark, SF)
    first, again = ({r.symbol: r.price_hash for r in price_hash(t).collect()} for t in (trades, trades.repartition(5)))
    newest = trades.groupBy("symbol").agg(F.max("ts_us").alias("ts_us"))
    moved = {r.symbol: r.price_hash for r in price_hash(trades.join(newest.withColumn("_x", F.lit(1)), ["symbol", "ts_us"], "left").withColumn("price_fp", F.col("price_fp") + F.coalesce("_x", F.lit(0)))).collect()}
    assert first == again and first and all(first[s] != moved[s] for s in first)
