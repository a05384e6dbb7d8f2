"""Queries and operators that take the whole of their input, against plain loops."""

from __future__ import annotations

import hashlib
import random
from datetime import UTC, datetime
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from tapeloom.functions import scalar as C
from tapeloom.operators import analytics as A
from tapeloom.plans import catalog

SF = "/root/testdata/sf0.001"


def momentum(directions, least, k_end=5):
    runs, before = [], None
    for d in directions:
        if d == before:
            runs[-1][1] += 1
        else:
            runs.append([d, 1])
        before = d
    at = lambda k: sum(d == "U" and n >= k for d, n in runs)
    if at(1) < max(least, 1) or at(k_end) < max(least, 1):
        return None
    return (1 - at(2) / at(1)) - (1 - at(k_end + 1) / at(k_end))


def test_walk_forward_reaches_the_last_fold(spark):
    rng = random.Random(13)
    series = {"a": [], "b": ["U"] * 300, "c": ["U"] * 199, "d": ["D"] * 260}
    while len(series["a"]) < 1017:
        series["a"] += [rng.choice("UD")] * rng.randint(1, 9)
    rows = spark.createDataFrame([(s, 250, i, x) for s, xs in series.items() for i, x in enumerate(xs)], "symbol string, threshold int, bar_id long, direction string")
    for least in (1, 3):
        got = {(r.symbol, r.fold): r for r in A.momentum_walk_forward(rows, 160, 40, least).collect()}
        want = {}
        for s, xs in series.items():
            i = 0
            while i + 200 <= len(xs):
                want[s, i // 40] = momentum(xs[i : i + 160], least), momentum(xs[i + 160 : i + 200], least)
                i += 40
        assert set(got) == set(want) and ("a", (len(series["a"]) - 200) // 40) in got
        for k, deltas in want.items():
            for mine, x in zip((got[k].train_delta, got[k].test_delta), deltas):
                assert (mine is None) == (x is None) and (x is None or abs(mine - x) < 1e-12)


def test_walk_forward_query_uses_every_bar(spark):
    bars = {r.symbol: r["count"] for r in catalog.QUERIES["rb_batch"](spark, SF).groupBy("symbol").count().collect()}
    folds = {r.symbol: r["count"] for r in catalog.QUERIES["st_wfo"](spark, SF).groupBy("symbol").count().collect()}
    assert folds == {s: (n - 160) // 40 for s, n in bars.items() if n >= 200}


def test_nearest_event_of_every_bar_among_all_trades(spark):
    from oracle_check import agree

    sql = "SELECT b.symbol, b.bar_id, arg_min(t.agg_trade_id, (abs(t.ts_us - b.close_time), t.agg_trade_id)) AS nearest FROM bars b JOIN trades t ON t.symbol = b.symbol GROUP BY ALL"
    agree(spark, catalog.QUERIES["jn_nearest_event"], f"{catalog.PLAIN}\n{sql}", SF)


def test_nearest_of_ties_and_gaps(spark):
    rng = random.Random(14)
    bars = [(s, i, rng.randrange(60)) for s in "ab" for i in range(40)]
    events = [(s, rng.randrange(60), i) for s in "a" for i in range(25)] + [("b", 30, 7), ("b", 30, 3)]
    got = A.nearest(spark.createDataFrame(bars, "symbol string, bar_id long, t long"), spark.createDataFrame(events, "symbol string, e long, event long"), "t", "e", ["symbol"], "event")
    want = {(s, i): min((abs(e - t), v) for q, e, v in events if q == s)[1] for s, i, t in bars}
    assert {(r.symbol, r.bar_id): r.event for r in got.collect()} == want


def test_adaptive_window_is_the_raw_values():
    rng = np.random.default_rng(15)
    window, raw = A.Adaptive(), []
    for k, x in enumerate(rng.gamma(1.0, 1.0, 3000)):
        window.add(float(x))
        raw.append(x)
        if k % 700 == 699:
            raw = raw[int(window.buckets[0, 0]) :]
            window.buckets = window.buckets[1:]
        sizes = window.buckets[:, 0]
        assert sizes.sum() == len(raw) and len(sizes) <= 6 * 12 and (np.diff(sizes) <= 0).all()
        assert max(np.unique(sizes, return_counts=True)[1]) <= A.Adaptive.MOST
    at = 0
    for n, s, v, m in window.buckets:
        part = np.array(raw[at : at + int(n)])
        assert np.allclose([s, v, m], [part.sum(), part.var() * len(part), part.max()])
        at += int(n)


def test_drift_that_needs_more_than_4096_bars_is_found(spark):
    rng = np.random.default_rng(16)
    n = 20_000

    def closes(symbol, x):
        step = np.sqrt(x) * np.where(np.arange(len(x)) % 2, 1, -1) * 1e-3
        return pd.DataFrame({"symbol": symbol, "bar_id": np.arange(len(x) + 1), "close": np.exp(np.cumsum(np.r_[0, step]))})

    frames = [closes("slow", np.r_[rng.random(n), rng.random(n) + 0.03]), closes("same", rng.random(n)), closes("fast", np.r_[rng.random(500), rng.random(500) + 2])]
    found: dict = {}
    for r in A.drift(spark.createDataFrame(pd.concat(frames))).collect():
        found.setdefault(r.symbol, []).append(r["at"])
    assert "same" not in found
    assert found["slow"] and min(found["slow"]) > n
    assert 500 < min(found["fast"]) < 550


@pytest.mark.parametrize("name", ["src_trades_csv", "src_trades_json", "src_arrow", "src_tick_store"])
def test_sources_pass_every_symbol(spark, name):
    from oracle_check import agree

    agree(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_digests_and_recovery_cover_every_table(spark):
    files = [p for t in Path(SF).glob("*.parquet") for p in ([t] if t.is_file() else t.glob("[!._]*"))]
    got = {r["name"]: (r.length, r.sha256) for r in catalog.QUERIES["src_checksum"](spark, SF).collect()}
    assert len(files) > 1 and got == {str(p.relative_to(SF)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files}
    assert tuple(catalog.QUERIES["src_parquet_recover"](spark, SF).first()) == (len(files), len(files))


def test_sessions_of_all_trades_and_in_daylight_saving(spark):
    rows = [(r.agg_trade_id, r.ts_us) for r in catalog.trades(spark, SF).select("agg_trade_id", "ts_us").collect()]
    got = {r.agg_trade_id: r.asDict() for r in catalog.QUERIES["fn_sessions"](spark, SF).collect()}
    assert len(got) == len(rows)
    summer = [(-k, 1_720_000_000_000_000 + k * 1_700_000_000) for k in range(1, 500)]
    got |= {r.i: r.asDict() for r in spark.createDataFrame(summer, "i long, ts long").select("i", *[c.alias(k) for k, c in C.sessions(catalog.F.col("ts")).items()]).collect()}
    for i, ts in rows + summer:
        for name, (zone, first, end) in C.SESSIONS.items():
            local = datetime.fromtimestamp(ts // 1_000_000, UTC).astimezone(ZoneInfo(zone))
            assert got[i][name] == (local.weekday() < 5 and first <= local.hour < end)
