"""Bars that go on after a stop, against one plain pass over all trades."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest

from tapeloom.operators import bars as B
from tapeloom.operators import resume as R

SCHEMA = "symbol string, agg_trade_id long, price_fp long, volume_fp long, first_trade_id long, last_trade_id long, ts_us long, is_buyer_maker boolean"
DAY = 86_400_000_000
START = 1_706_500_000_000_000
WHAT = ["symbol", "threshold", "segment", "bar_id", "open_fp", "high_fp", "low_fp", "close_fp", "open_time", "close_time", "first_trade_id", "last_trade_id", "first_agg_trade_id", "last_agg_trade_id", "volume_fp", "buy_volume_fp", "sell_turnover_fp", "turnover_fp", "individual_trade_count", "sell_trade_count", "vwap_fp", "is_complete"]


def walk(seed, symbol, n, days):
    rng, price, rows = random.Random(seed), 10**10, []
    for i, at in enumerate(sorted(rng.randrange(days * DAY) for _ in range(n))):
        price += rng.randint(-12, 12) * 10**6
        rows.append((symbol, i, price, rng.randint(1, 9) * 10**7, i * 2, i * 2 + 1, START + at // 60_000_000 * 60_000_000, rng.random() < 0.5))
    return rows


@pytest.fixture(scope="module")
def trades(spark):
    return spark.createDataFrame(walk(1, "a", 900, 9) + walk(2, "b", 500, 9) + walk(3, "late", 60, 2), SCHEMA).cache()


def rows(df, what=WHAT):
    return sorted(tuple(r) for r in df.select(*what).collect())


@pytest.mark.parametrize("segment", [None, "month"])
def test_any_cut_gives_the_bars_of_one_pass(spark, trades, segment):
    mode = B.calendar_segment(B.F.col("ts_us"), segment) if segment else None
    want = rows(B.aggregated(B.assigned(trades, (250, 600), mode)))
    for cut in (START - 1, START + DAY, START + 3 * DAY + 7, START + 20 * DAY):
        first = R.continued(trades.filter(B.F.col("ts_us") < cut), None, (250, 600), segment, most_gap_us=None)
        state = R.tails(first)
        rest = R.continued(trades.filter(B.F.col("ts_us") >= cut), state, (250, 600), segment, most_gap_us=None)
        ended = first.filter("is_complete").unionByName(rest)
        over = first.filter("not is_complete").join(state, B.BAR, "left_anti").select(*first.columns)
        assert rows(ended.unionByName(over)) == want


def test_trades_that_come_again_are_passed_over(spark, trades):
    cut = START + 4 * DAY
    first = R.continued(trades.filter(B.F.col("ts_us") < cut), None, most_gap_us=None)
    rest = R.continued(trades, R.tails(first), most_gap_us=None)
    assert rows(first.filter("is_complete").unionByName(rest)) == rows(B.aggregated(B.assigned(trades)))


def plain(trades, cut, gap):
    """Bar id, opening price and number of trades, by a loop that drops a forming bar at the cut."""
    out, by = [], {}
    for t in sorted(trades, key=lambda t: (t.symbol, t.ts_us, t.agg_trade_id)):
        by.setdefault(t.symbol, []).append(t)
    for symbol, ts in by.items():
        bar, n, last = None, 0, None
        for t in ts:
            if bar is not None and last < cut <= t.ts_us and t.ts_us - last > gap:
                bar = None
            last = t.ts_us
            if bar is None:
                bar, size, opened = t.price_fp, 0, t.ts_us
            size += 1
            away = bar * 250 // 100_000
            if t.ts_us != opened and abs(t.price_fp - bar) >= away:
                out.append((symbol, n, bar, size))
                bar, n = None, n + 1
    return sorted(out)


def test_a_forming_bar_is_dropped_after_a_long_gap_only(spark, trades):
    every, dropped = trades.collect(), 0
    for k in range(1, 8):
        cut = START + k * DAY
        first = R.continued(trades.filter(B.F.col("ts_us") < cut), None)
        for gap in (60_000_000, 10 * 60_000_000, 10 * DAY):
            rest = R.continued(trades.filter(B.F.col("ts_us") >= cut), R.tails(first), most_gap_us=gap)
            got = rows(first.unionByName(rest).filter("is_complete"), ["symbol", "bar_id", "open_fp", "agg_record_count"])
            assert got == plain(every, cut, gap)
            dropped += got != plain(every, cut, 100 * DAY)
    assert dropped


def test_population_goes_on_after_a_loss(spark, trades, tmp_path, monkeypatch):
    read = lambda a, b: trades.filter(B.F.col("ts_us").between(a, b))
    make = lambda: R.Population(spark, str(tmp_path), (250,), most_gap_us=None)
    assert make().progress() is None
    with pytest.raises(ValueError, match="nothing"):
        make().bars()
    told = []
    assert make().run(read, START, START + 9 * DAY, "day", most=3, told=lambda **k: told.append(k)) == 3 == len(told)

    write = R.Population._write

    def lost(self, rows, kind, chunk):
        if kind == "progress":
            raise OSError("lost")
        write(self, rows, kind, chunk)

    monkeypatch.setattr(R.Population, "_write", lost)
    with pytest.raises(OSError):
        make().run(read, START, START + 9 * DAY, "day")
    monkeypatch.undo()
    before = make().bars().count()
    with pytest.raises(ValueError, match="missing"):
        make().run(read, START + 8 * DAY, START + 9 * DAY, "day")
    assert make().run(read, START, START + 9 * DAY, "day") == 7 and make().bars().count() > before
    assert make().run(read, START, START + 9 * DAY, "day") == 0
    want = B.range_bars(trades, include_incomplete=True)
    what = [*B.BAR, "open_time", "close_time", "open", "close", "volume", "ofi", "is_complete"]
    assert rows(make().bars(include_incomplete=True), what) == rows(want, what)
    last = make().last_bars(5, read, START, START + 9 * DAY, "day")
    assert {r.symbol: r["count"] for r in last.groupBy("symbol").count().collect()} == {r.symbol: min(5, r["count"]) for r in want.filter("is_complete").groupBy("symbol").count().collect()}


def test_months_end_their_bars(spark, trades, tmp_path):
    p = R.Population(spark, str(tmp_path), (250,), "month")
    read = lambda a, b: trades.filter(B.F.col("ts_us").between(a, b))
    assert p.run(read, START, START + 9 * DAY) == 2
    want = B.range_bars(trades, segment=B.calendar_segment(B.F.col("ts_us")), include_incomplete=True)
    what = [*B.BAR, "open_time", "close", "volume", "is_complete"]
    assert rows(p.bars(include_incomplete=True), what) == rows(want, what)


def test_chunks_cover_the_time_asked_for():
    month = list(R.chunks(START, START + 40 * DAY, "month"))
    assert month[0][0] <= START and month[-1][1] >= START + 40 * DAY and all(a[1] == b[0] for a, b in zip(month, month[1:]))
    assert len(list(R.chunks(0, 3 * DAY, "day"))) == 3 and list(R.chunks(5, 5 - DAY, "day")) == []
    with pytest.raises(ValueError):
        list(R.chunks(0, 1, "year"))
    week = list(R.chunks(START, START + 9 * DAY, "week"))
    assert all(datetime.fromtimestamp(a // 1_000_000, UTC).strftime("%a %H:%M") == "Sun 00:00" for pair in week for a in pair) and week[0][0] <= START < week[0][1]
