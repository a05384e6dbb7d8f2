from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.functions import series as N
from tapeloom.operators.bars import Walk, assigned, calendar_segment, range_bars


def plain(price, ts, threshold, gate):
    """Trade by trade."""
    ids, closes, bar, opened = [], [], -1, None
    for p, t in zip(price, ts):
        if opened is None:
            bar, opened = bar + 1, (p, t)
            ids.append(bar), closes.append(False)
            continue
        away = opened[0] * threshold // 100_000
        hit = (p >= opened[0] + away or p <= opened[0] - away) and (not gate or t != opened[1])
        ids.append(bar), closes.append(hit)
        if hit:
            opened = None
    return ids, closes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(900, 1100), st.integers(0, 3)), min_size=1, max_size=200), st.integers(100, 5000), st.booleans(), st.lists(st.integers(0, 200), max_size=4))
def test_walk_is_the_plain_loop_however_it_is_split(steps, threshold, gate, cuts):
    price = np.array([p * 10**6 for p, _ in steps])
    ts = np.cumsum([d for _, d in steps])
    want = plain(price.tolist(), ts.tolist(), threshold, gate)
    walk, ids, closes = Walk(threshold, gate), [], []
    for a, b in zip([0, *sorted(min(c, len(price)) for c in cuts)], [*sorted(min(c, len(price)) for c in cuts), len(price)]):
        i, c = walk.take(price[a:b], ts[a:b])
        ids += i.tolist()
        closes += c.tolist()
    assert (ids, closes) == want


def test_breach_is_inclusive_and_the_next_trade_opens(spark):
    rows = [("s", i, p * 10**8, 10**8, i, i, i * 1000, False) for i, p in enumerate([50000, 50100, 50125, 49000, 49010])]
    df = spark.createDataFrame(rows, "symbol string, agg_trade_id long, price_fp long, volume_fp long, first_trade_id long, last_trade_id long, ts_us long, is_buyer_maker boolean")
    bars = range_bars(df, (250,), include_incomplete=True).orderBy("bar_id").collect()
    assert [(b.open, b.close, b.is_complete) for b in bars] == [(50000.0, 50125.0, True), (49000.0, 49010.0, False)]


def test_empty_and_bad_thresholds(spark):
    df = spark.createDataFrame([], "symbol string, agg_trade_id long, price_fp long, volume_fp long, first_trade_id long, last_trade_id long, ts_us long, is_buyer_maker boolean")
    assert range_bars(df).count() == 0
    with pytest.raises(ValueError):
        assigned(df, (0,))
    with pytest.raises(ValueError):
        calendar_segment(df["ts_us"], "day")


def test_epochs_of_a_rise_and_a_fall():
    up = np.array([1.0, 1.02, 1.01, 1.05, 1.04, 1.10])
    n, gain, cv = N.epochs(up, N.drawdown(up))
    assert n == 3 and gain > 0 and cv >= 0
    down = 1 / up
    assert N.epochs(1 / down, N.runup(down))[0] == n
    assert math.isnan(N.epochs(np.ones(5), 0.1)[2])


def test_tables_and_entropy():
    assert N.density_score(0.5) == 0.13030270 and N.density_score(1.0) == 0.69848350
    assert N.tanh_score(-0.5) == -0.46211716 and N.variation_score(float("nan")) == 0.11920292 and N.variation_score(5.0) == 0.99999998
    assert N.permutation_entropy(np.arange(80.0)) == 0.0
    rng = np.random.default_rng(1)
    assert N.permutation_entropy(rng.random(4000)) > 0.99
    assert 0 <= N.approximate_entropy(rng.random(600)) <= 1
    assert N.hurst_dfa(np.ones(100)) == 0.5


def test_look_back_by_bars_counts_all_trades_of_those_bars(spark):
    """Long enough that trades which can't be asked for again have been dropped many times; a first bar has no window."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tapeloom.operators import windows as W
    from tapeloom.plans import catalog

    rows = catalog.ids(spark, "/root/testdata/sf0.1").persist()
    got = {(r.symbol, r.bar_id): r.lookback_trade_count for r in W.bar_windows(rows, W.Lookback(bars=5, tier2=False, tier3=False), within=False).collect()}
    each = rows.groupBy("symbol", "bar_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("opened"), F.max("ts_us").alias("closed"))
    order = Window.partitionBy("symbol").orderBy("bar_id")
    each = each.withColumn("before", F.sum("n").over(order.rowsBetween(-5, -1))).withColumn("tied", F.lag("closed").over(order) == F.col("opened"))
    want = {(r.symbol, r.bar_id): r.before for r in each.filter("not coalesce(tied, false)").collect()}
    rows.unpersist()
    assert len(want) > 5000 and {k: got[k] for k in want} == want
