"""Price-range bars: which bar each trade belongs to, and what a bar is.

A bar opens with a trade and closes with the first later trade that is `threshold` (in 1e-5) or more away from the opening
price; that trade still belongs to it and the next one opens the next bar. Assigning trades to bars depends on the path, so
it is the one step in Python: partitions sorted by key and time pass through as Arrow batches, with one open bar as the only
state, however many trades a key has. All else is aggregation by bar in the JVM.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["symbol", "threshold", "segment"]
BAR = [*KEYS, "bar_id"]
EPS = 2.220446049250313e-16


def ship(spark) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


class Walk:
    """The forming bar of one key; takes its trades in order, any number at a time."""

    def __init__(self, threshold: int, gate: bool = True, bar: int = -1, open_price: int | None = None, open_ts: int = 0):
        self.threshold, self.gate, self.bar, self.open_price, self.open_ts = threshold, gate, bar, open_price, open_ts

    def take(self, price: np.ndarray, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bar of each trade, and whether the trade closes it."""
        n, i = len(price), 0
        ids, closes = np.empty(n, np.int64), np.zeros(n, bool)
        while i < n:
            start = i
            if self.open_price is None:
                self.bar, self.open_price, self.open_ts = self.bar + 1, int(price[i]), int(ts[i])
                i += 1
            away = self.open_price * self.threshold // 100_000
            reach, found = 64, -1
            while i < n:  # in growing strides, so that short and long bars are both cheap
                p = price[i : i + reach]
                hit = (p >= self.open_price + away) | (p <= self.open_price - away)
                if self.gate:
                    hit &= ts[i : i + reach] != self.open_ts
                at = int(hit.argmax()) if len(hit) else 0
                if len(hit) and hit[at]:
                    found = i + at
                    break
                i, reach = i + reach, min(reach * 2, 1 << 16)
            end = found + 1 if found >= 0 else n
            ids[start:end] = self.bar
            if found >= 0:
                closes[found] = True
                self.open_price = None
            i = end
        return ids, closes


def runs(*columns: np.ndarray) -> np.ndarray:
    """Bounds of the stretches in which all columns stay equal."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    turn = np.zeros(n - 1, bool)
    for c in columns:
        turn |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(turn) + 1, [n]])


def _keys(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in names]


def assigned(trades: DataFrame, thresholds: Sequence[int] = (250,), segment: Column | None = None, gate: bool = True, carry: Sequence[str] | None = None, tails: DataFrame | None = None, most_gap_us: int | None = None) -> DataFrame:
    """Trades with threshold, segment, bar_id (from 0 in each symbol, threshold and segment) and closes.

    Trades are ordered by (ts_us, agg_trade_id). With `gate` a bar doesn't close at its opening time. `segment` restarts bars;
    without it, all is one segment. `carry`: the columns to take along (all).

    `tails`: the last bar of keys so far (operators.resume), from which they go on; trades that don't come after their key's
    tail have been counted and are passed over. A forming bar is dropped, and its number taken by the next one, where the first
    trade comes more than `most_gap_us` after its last.
    """
    ship(trades.sparkSession)
    for t in thresholds:
        if not 1 <= t <= 100_000:
            raise ValueError(f"threshold {t} is not in 1..100000")
    cols = list(dict.fromkeys(["symbol", "ts_us", "agg_trade_id", "price_fp", *(carry if carry is not None else trades.columns)]))
    segment = F.lit(0).cast("long") if segment is None else segment.cast("long")
    rows = trades.withColumn("segment", segment).select(*cols, "segment", F.explode(F.array(*[F.lit(int(t)) for t in thresholds])).alias("threshold"))
    schema = T.StructType([*rows.schema, T.StructField("bar_id", T.LongType()), T.StructField("closes", T.BooleanType())])
    first = []
    if tails is not None:
        known = tails.select(*KEYS, F.col("close_time").alias("ts_us"), F.col("last_agg_trade_id").alias("agg_trade_id"), F.col("open_fp").alias("price_fp"), F.col("bar_id").alias("_bar"), F.col("open_time").alias("_opened"), F.col("is_complete").alias("_done"))
        rows = rows.withColumns({"_bar": F.lit(-1).cast("long"), "_opened": F.lit(0).cast("long"), "_done": F.lit(False)}).unionByName(known, allowMissingColumns=True)
        first = [F.desc("_bar")]
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, *first, "ts_us", "agg_trade_id")

    def resumed(batches):
        key, walk, last = None, None, None
        for batch in batches:
            keys = _keys(batch, KEYS)
            price, ts, trade, bar, opened, done = _keys(batch, ["price_fp", "ts_us", "agg_trade_id", "_bar", "_opened", "_done"])
            ids, closes, keep = np.zeros(len(ts), np.int64), np.zeros(len(ts), bool), np.zeros(len(ts), bool)
            bounds = runs(*keys)
            for a, b in zip(bounds[:-1], bounds[1:]):
                now = tuple(k[a] for k in keys)
                if now != key:
                    key, walk, last = now, Walk(int(now[1]), gate), None
                    if bar[a] >= 0:
                        walk = Walk(int(now[1]), gate, int(bar[a]), None if done[a] else int(price[a]), int(opened[a]))
                        last, a = (ts[a], trade[a]), a + 1
                if last is not None:
                    a += int(((ts[a:b] < last[0]) | ((ts[a:b] == last[0]) & (trade[a:b] <= last[1]))).sum())
                    if a < b:
                        if most_gap_us is not None and walk.open_price is not None and ts[a] - last[0] > most_gap_us:
                            walk.bar, walk.open_price = walk.bar - 1, None
                        last = None
                keep[a:b] = True
                ids[a:b], closes[a:b] = walk.take(price[a:b], ts[a:b])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in schema.names[:-2]], pa.array(ids), pa.array(closes)], schema.names).filter(pa.array(keep))

    def run(batches):
        key, walk = None, None
        for batch in batches:
            keys = _keys(batch, KEYS)
            price, ts = _keys(batch, ["price_fp", "ts_us"])
            bounds = runs(*keys)
            ids, closes = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                now = tuple(k[a] for k in keys)
                if now != key:
                    key, walk = now, Walk(int(now[1]), gate)
                i, c = walk.take(price[a:b], ts[a:b])
                ids.append(i)
                closes.append(c)
            if ids:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(ids)), pa.array(np.concatenate(closes))], [*batch.schema.names, "bar_id", "closes"])

    return rows.mapInArrow(run if tails is None else resumed, schema)


def money(col: str) -> Column:
    return F.col(col) / F.lit(100_000_000.0)


def aggregated(rows: DataFrame, by_record: bool = False, source: str = "derived") -> DataFrame:
    """Bars from trades with bar_id: prices, times, ids, volumes, counts, turnover and VWAP. Sums are exact whole numbers.

    by_record counts one for each record instead of the individual trades that it stands for.
    """
    turnover = F.col("price_fp").cast("decimal(19,0)") * F.col("volume_fp").cast("decimal(18,0)")
    n = F.lit(1) if by_record else F.col("last_trade_id") - F.col("first_trade_id") + 1
    buy, sell, order = ~F.col("is_buyer_maker"), F.col("is_buyer_maker"), F.struct("ts_us", "agg_trade_id")
    bars = rows.groupBy(*BAR).agg(
        F.min_by("price_fp", order).alias("open_fp"), F.max("price_fp").alias("high_fp"), F.min("price_fp").alias("low_fp"), F.max_by("price_fp", order).alias("close_fp"),
        F.min("ts_us").alias("open_time"), F.max("ts_us").alias("close_time"),
        F.min_by("first_trade_id", order).alias("first_trade_id"), F.max_by("last_trade_id", order).alias("last_trade_id"), F.min_by("agg_trade_id", order).alias("first_agg_trade_id"), F.max_by("agg_trade_id", order).alias("last_agg_trade_id"),
        F.sum("volume_fp").alias("volume_fp"), F.coalesce(F.sum(F.when(buy, F.col("volume_fp"))), F.lit(0)).alias("buy_volume_fp"), F.coalesce(F.sum(F.when(sell, F.col("volume_fp"))), F.lit(0)).alias("sell_volume_fp"),
        F.sum(turnover).cast("decimal(38,0)").alias("turnover_fp"), F.coalesce(F.sum(F.when(buy, turnover)), F.lit(0)).cast("decimal(38,0)").alias("buy_turnover_fp"), F.coalesce(F.sum(F.when(sell, turnover)), F.lit(0)).cast("decimal(38,0)").alias("sell_turnover_fp"),
        F.sum(n).cast("long").alias("individual_trade_count"), F.count(F.lit(1)).alias("agg_record_count"),
        F.coalesce(F.sum(F.when(buy, n)), F.lit(0)).cast("long").alias("buy_trade_count"), F.coalesce(F.sum(F.when(sell, n)), F.lit(0)).cast("long").alias("sell_trade_count"),
        F.max("closes").alias("is_complete"),
    )
    return with_vwap(bars).withColumn("data_source", F.lit(source))


def with_vwap(bars: DataFrame) -> DataFrame:
    return bars.withColumn("vwap_fp", F.when(F.col("volume_fp") > 0, F.expr("cast(turnover_fp div cast(volume_fp as decimal(38,0)) as bigint)")).otherwise(F.col("open_fp")))


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0, least: float = EPS) -> Column:
    return F.when(bottom > least, top * (F.lit(1.0) / bottom)).otherwise(F.lit(otherwise))


FEATURES = ("duration_us", "ofi", "vwap_close_deviation", "price_impact", "kyle_lambda_proxy", "trade_intensity", "volume_per_trade", "aggression_ratio", "aggregation_density", "turnover_imbalance")


def features() -> dict[str, Column]:
    """The ten features of a bar, from the columns of `aggregated`."""
    o, h, lo, c, v = (money(f"{x}_fp") for x in ("open", "high", "low", "close", "volume"))
    bv, sv = money("buy_volume_fp"), money("sell_volume_fp")
    bt, st = (F.col(f"{x}_turnover_fp").cast("double") / F.lit(1e16) for x in ("buy", "sell"))
    n, bn, sn = (F.col(f"{x}_trade_count").cast("double") for x in ("individual", "buy", "sell"))
    duration = F.col("close_time") - F.col("open_time")
    ofi = _ratio(bv - sv, bv + sv)
    return {
        "duration_us": duration,
        "ofi": ofi,
        "vwap_close_deviation": _ratio(c - money("vwap_fp"), h - lo),
        "price_impact": _ratio(F.abs(c - o), v),
        "kyle_lambda_proxy": F.when((F.abs(ofi) > EPS) & (F.abs(o) > EPS), (c - o) * (F.lit(1.0) / F.abs(o)) * (F.lit(1.0) / ofi)).otherwise(F.lit(0.0)),
        "trade_intensity": F.when(duration > 0, n * (F.lit(1.0) / (duration.cast("double") / F.lit(1e6)))).otherwise(n),
        "volume_per_trade": F.when(n > 0, v * (F.lit(1.0) / n)).otherwise(F.lit(0.0)),
        "aggression_ratio": F.when(sn > 0, F.least(bn * (F.lit(1.0) / sn), F.lit(100.0))).when(bn > 0, F.lit(100.0)).otherwise(F.lit(1.0)),
        "aggregation_density": F.when(F.col("agg_record_count") > 0, n * (F.lit(1.0) / F.col("agg_record_count").cast("double"))).otherwise(F.lit(1.0)),
        "turnover_imbalance": _ratio(bt - st, bt + st),
    }


def priced(bars: DataFrame) -> DataFrame:
    """Bars with prices and volumes as doubles, and the features."""
    names = [*BAR, "open_time", "close_time", "first_trade_id", "last_trade_id", "first_agg_trade_id", "last_agg_trade_id", "individual_trade_count", "agg_record_count", "buy_trade_count", "sell_trade_count", "is_complete", "data_source"]
    prices = [money(f"{x}_fp").alias(x) for x in ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "vwap")]
    turnovers = [(F.col(f"{x}_fp").cast("double") / F.lit(1e16)).alias(x) for x in ("turnover", "buy_turnover", "sell_turnover")]
    return bars.select(*names, *prices, *turnovers, *[f.alias(k) for k, f in features().items()])


def range_bars(trades: DataFrame, thresholds: Sequence[int] = (250,), segment: Column | None = None, gate: bool = True, include_incomplete: bool = False) -> DataFrame:
    """Bars with prices and features; the forming bar of each key only on request."""
    bars = aggregated(assigned(trades, thresholds, segment, gate, carry=["volume_fp", "first_trade_id", "last_trade_id", "is_buyer_maker"]))
    return priced(bars if include_incomplete else bars.filter("is_complete"))


# ---------------------------------------------------------------- segments


def calendar_segment(ts: Column, mode: str = "month") -> Column:
    """Start (microseconds UTC) of the year, month or week from Sunday that a time falls in."""
    t = F.timestamp_micros(ts)
    if mode == "week":
        day = F.floor(ts / 86_400_000_000).cast("long")  # 1970-01-01 was a Thursday
        return (day - F.pmod(day + 4, F.lit(7))) * 86_400_000_000
    if mode not in ("year", "month"):
        raise ValueError(f"segment mode {mode}")
    return F.unix_micros(F.date_trunc(mode, t))


def with_gap_segment(trades: DataFrame, hours: float = 40.0, name: str = "gap_segment") -> DataFrame:
    """Numbers the stretches of each symbol's trades that are `hours` or more apart (weekends of foreign exchange)."""
    w = Window.partitionBy("symbol").orderBy("ts_us", "agg_trade_id")
    step = F.when(F.col("ts_us") - F.lag("ts_us").over(w) >= int(hours * 3_600_000_000), 1).otherwise(0)
    return trades.withColumn("_step", step).withColumn(name, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_step")


# ---------------------------------------------------------------- checks of order and position


def out_of_order(trades: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Trades that don't come after the one that arrived before them."""
    w = Window.partitionBy("symbol").orderBy(arrival)
    before = F.lag(F.struct("ts_us", "agg_trade_id")).over(w)
    return trades.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.struct("ts_us", "agg_trade_id") <= F.col("_before"))).drop("_before")


def positions(bars: DataFrame) -> DataFrame:
    """How each bar follows the one before: first, exact, gap or overlap, and how many trades are missing."""
    w = Window.partitionBy(*KEYS).orderBy("bar_id")
    missing = F.col("first_trade_id") - F.lag("last_trade_id").over(w) - 1
    return bars.select(*BAR, missing.alias("missing"), F.when(missing.isNull(), "first").when(missing == 0, "exact").when(missing > 0, "gap").otherwise("overlap").alias("position"))


def checkpoints(rows: DataFrame) -> DataFrame:
    """The state of each key after its last trade, from trades with bar_id and closes: the forming bar's opening price and time
    and its limits; none of them if the next trade opens a bar."""
    order = F.struct("ts_us", "agg_trade_id")
    bars = rows.groupBy(*BAR).agg(F.min_by("price_fp", order).alias("open_fp"), F.min("ts_us").alias("open_time"), F.max("closes").alias("_done"), F.max(order).alias("_last"))
    last = bars.groupBy(*KEYS).agg(F.max_by(F.struct("bar_id", "open_fp", "open_time", "_done", "_last"), "bar_id").alias("_b")).select(*KEYS, "_b.*")
    away = F.expr("open_fp * threshold div 100000")
    forming = ~F.col("_done")
    return last.select(
        *KEYS, "bar_id", F.col("_last.ts_us").alias("last_ts"), F.col("_last.agg_trade_id").alias("last_id"), F.col("_done").alias("next_opens"),
        *[F.coalesce(F.when(forming, c), F.lit(-1)).alias(n) for n, c in (("open_fp", F.col("open_fp")), ("upper_fp", F.col("open_fp") + away), ("lower_fp", F.col("open_fp") - away), ("open_time", F.col("open_time")))],
    )


def walk_of(state) -> Walk:
    """A walk that goes on from a row of `checkpoints`."""
    return Walk(state["threshold"], True, state["bar_id"], None if state["next_opens"] else state["open_fp"], state["open_time"])
